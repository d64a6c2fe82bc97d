"""Alert rules: definitions, matching and cooldown over a table of lines, and payloads for channels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_time
from ..plans.query import valid

SEVERITIES = ("info", "warning", "critical")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    is_regex: bool = False
    flags: str = ""
    severity: str = "warning"
    cooldown: int = 60

    def matches(self, content: Column) -> Column:
        """A regular expression, else a substring whatever its case."""
        if not self.is_regex:
            return F.contains(F.lower(content), F.lit(self.pattern.lower()))
        kept = "".join(sorted(set(self.flags) & set("ims")))
        return content.rlike((f"(?{kept})" if kept else "") + self.pattern)


def fault(definition: dict) -> str | None:
    """What is wrong with a definition, or None."""
    name, pattern = (str(definition.get(k) or "").strip() for k in ("name", "pattern"))
    if not name:
        return "a rule needs a name"
    if not pattern:
        return f"rule {name!r} needs a pattern"
    if (severity := definition.get("severity")) and severity not in SEVERITIES:
        return f"rule {name!r} has an unknown severity: {severity}"
    whole = re.fullmatch(r"/(.*)/([a-z]*)", definition["pattern"], re.S)
    if whole and (not valid(whole[1]) or set(whole[2]) - set("dgimsuvy")):
        return f"rule {name!r} has an invalid regular expression"
    return None


def rule(definition: dict) -> Rule:
    if wrong := fault(definition):
        raise ValueError(wrong)
    whole = re.fullmatch(r"/(.*)/([a-z]*)", definition["pattern"], re.S)
    body, flags = whole.groups() if whole else (definition["pattern"], "")
    cooldown = definition.get("cooldown")
    return Rule(definition["name"].strip(), body, bool(whole), flags, definition.get("severity") or "warning", 60 if cooldown is None else int(cooldown))


def rules(definitions: str | list[dict]) -> list[Rule]:
    """Rules of a JSON array or of a list of definitions."""
    if isinstance(definitions, str):
        try:
            definitions = json.loads(definitions)
        except ValueError as e:
            raise ValueError(f"rules are not valid JSON: {e}") from e
    if not isinstance(definitions, list):
        raise ValueError("rules must be a JSON array")
    return [rule(d) for d in definitions]


def match_rules(lines: DataFrame, wanted: list[Rule], width: int | None = 200) -> DataFrame:
    """A row for each line and rule that matches: rule, severity, cooldown, ts, file, line_no and the line, or its first ``width`` characters.

    Every rule is a column expression, so the lines are read once and nothing is joined.
    """
    found = F.array_compact(F.array(*(F.when(r.matches(F.col("content")), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.cooldown).alias("cooldown"))) for r in wanted)))
    return lines.select(F.inline(found), line_time(F.col("content")).alias("ts"), "file", "line_no", (F.substring("content", 1, width) if width is not None else F.col("content")).alias("line"))


def notified(alerts: DataFrame) -> DataFrame:
    """rule, severity and ts of the alerts that a notifier sends: those at least the cooldown after the last one sent.

    Each rule and severity has its own clock, the alerts' times. Alerts without a time, and all of a rule without a
    cooldown, are sent each. Alerts of the same second are first made one, so a rule's rows in a task, which are read
    in order with one number kept, grow with the seconds that it covers and not with its alerts.
    """
    columns = ["rule", "severity", "ts"]
    free = F.col("ts").isNull() | (F.col("cooldown") <= 0)
    seconds = alerts.where(~free).select(*columns, "cooldown").distinct().withColumn("at", F.unix_micros("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            kept = []
            for i, (*own, cooldown, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rule", "severity", "cooldown", "at")), strict=True)):
                if own != key or at - last >= cooldown * 1_000_000:
                    kept.append(i)
                    key, last = own, at
            yield batch.take(pa.array(kept, pa.int64())).select(columns)

    ordered = seconds.repartition("rule", "severity").sortWithinPartitions("rule", "severity", "ts")
    return alerts.where(free).select(*columns).unionByName(ordered.mapInArrow(run, alerts.select(*columns).schema))


#: Fixed values of the channels' payloads.
COLOURS = {"critical": "#FF0000", "warning": "#FFA500", "info": "#36a64f"}


def payload(channel: dict, alert: dict) -> dict:
    """What is posted to a channel of type slack, discord, webhook, pagerduty or email."""
    kind, colour, text = channel["type"], COLOURS.get(alert["severity"], COLOURS["info"]), alert["line"][:1000]
    if kind == "slack":
        fields = [{"title": "Severity", "value": alert["severity"].upper(), "short": True}, {"title": "Time", "value": str(alert["ts"]), "short": True}]
        if alert.get("file"):
            fields.append({"title": "File", "value": str(alert["file"]), "short": False})
        return {"attachments": [{"color": colour, "title": f"Alert: {alert['rule']}", "text": f"```{text}```", "fields": fields}]}
    if kind == "discord":
        return {"embeds": [{"title": f"Alert: {alert['rule']}", "description": f"```{text}```", "color": int(colour[1:], 16)}]}
    if kind == "pagerduty":
        severity = {"critical": "critical", "warning": "warning"}.get(alert["severity"], "info")
        return {"routing_key": channel.get("routing_key"), "event_action": "trigger", "payload": {"summary": f"{alert['rule']}: {text[:200]}", "severity": severity, "source": str(alert.get("file") or "log")}}
    if kind == "email":
        return {"to": channel.get("to"), "subject": f"[{alert['severity']}] {alert['rule']}", "body": text}
    if kind == "webhook":
        return {k: str(v) if k == "ts" else v for k, v in alert.items()}
    raise ValueError(f"unknown channel: {kind}")


class Notifier:
    """Sends alerts to a channel by ``transport(channel, payload)``, at most one a cooldown for each rule and severity."""

    def __init__(self, channel: dict, transport: Callable[[dict, dict], None], clock: Callable[[], float]):
        self.channel, self.transport, self.clock = channel, transport, clock
        self.last: dict[tuple[str, str], float] = {}

    def send(self, alert: dict, cooldown: float = 60.0) -> bool:
        key, now = (alert["rule"], alert["severity"]), self.clock()
        if key in self.last and now - self.last[key] < cooldown:
            return False
        self.last[key] = now  # before sending, so that a failing channel is not stormed either
        self.transport(self.channel, payload(self.channel, alert))
        return True

