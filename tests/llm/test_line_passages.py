"""Lines that recur across unrelated documents, beside others that do, beside copies, in variants, long and short."""

import random

from logquarry.llm import line_templates


def line(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8))) for _ in range(n))


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}


def test_lines_of_one_passage_go_together(spark):
    r = random.Random(1)
    passage = [line(r, 8) for _ in range(5)]
    own = {i: [line(r, 12) for _ in range(4)] for i in range(60)}
    found = cleaned(spark, {i: "\n".join(x + passage) for i, x in own.items()})
    assert found == {i: "\n".join(x) for i, x in own.items()}


def test_copies_count_once_and_do_not_protect_a_line(spark):
    r = random.Random(2)
    passage = line(r, 9)
    own = {i: "\n".join(line(r, 12) for _ in range(4)) for i in range(20)}
    own |= {100 + i: own[0] for i in range(60)}
    assert cleaned(spark, {i: f"{x}\n{passage}" for i, x in own.items()}) == own


def test_few_variants_in_many_documents_are_generalised(spark):
    r = random.Random(3)
    own = {i: "\n".join(line(r, 12) for _ in range(4)) for i in range(65)}
    few = "session opened for user {} who logged in from the terminal just today"
    rare = "the mirror at {} keeps a copy of this page for all of its readers"
    names = [line(r, 1) for _ in range(9)]
    texts = {i: own[i] + "\n" + few.format(names[i % 5]) for i in range(25)}  # 5 variants, 5 documents each
    texts |= {i: own[i] + "\n" + rare.format(names[0]) for i in range(25, 55)}  # recurs as it is
    texts |= {i: own[i] + "\n" + rare.format(names[1 + i % 2]) for i in range(55, 60)}  # variants of it in 5 documents
    texts |= {i: own[i] + "\n" + f"{names[i % 5]} of them is a line that only five documents have" for i in range(60, 65)}
    assert cleaned(spark, texts) == {i: own[i] if i < 60 else t for i, t in texts.items()}


def test_long_lines_are_generalised(spark):
    r = random.Random(4)
    own = {i: "\n".join(line(r, 60) for _ in range(4)) for i in range(20)}
    before, after = line(r, 40), line(r, 59)
    assert cleaned(spark, {i: f"{x}\n{before} {line(r, 1)}x {after}" for i, x in own.items()}) == own


def test_boilerplate_of_any_number_of_lines_goes(spark):
    r = random.Random(5)
    texts, expected = {}, {}
    for case, (shared, own) in enumerate([(1, 3), (2, 10), (5, 10), (20, 10)]):
        passage = [line(r, 9) for _ in range(shared)]
        for i in range(60):
            unique = [line(r, 12) for _ in range(own)]
            texts[100 * case + i] = "\n".join(passage[: shared // 2] + unique + passage[shared // 2 :])
            expected[100 * case + i] = "\n".join(unique)
    assert cleaned(spark, texts) == expected


def test_long_lines_recur_in_fewer_documents_and_short_ones_beside_others(spark):
    r = random.Random(6)
    own = {i: "\n".join(line(r, 12) for _ in range(4)) for i in range(60)}
    passage, licence = line(r, 55), line(r, 9)
    texts = {i: f"{passage}\n{x}" for i, x in own.items() if i < 3}
    texts |= {i: f"{x}\nEnd.\n{licence}\n\nThe end." for i, x in own.items() if 3 <= i < 30}
    texts |= {i: f"{x}\nEnd." for i, x in own.items() if i >= 30}
    expected = {i: own[i] if i < 3 else own[i] + "\n" if i < 30 else t for i, t in texts.items()}
    assert cleaned(spark, texts) == expected


def brute(texts, groups):
    """Exact templates only, of lines without near variants: contexts are given."""
    held = {}
    for i, text in texts.items():
        for x in text.split("\n"):
            held.setdefault(" ".join("<*>" if any(c.isdigit() for c in w) else w for w in x.split()), set()).add(groups[i])
    gone = {t for t, g in held.items() if len(g) >= (3 if len(t.split()) >= 50 else 10)}
    return {i: "\n".join(x for x in t.split("\n") if " ".join("<*>" if any(c.isdigit() for c in w) else w for w in x.split()) not in gone) for i, t in texts.items()}


def test_matches_brute_force_whichever_way_templates_are_sent(spark, monkeypatch):
    r = random.Random(8)
    pool = [line(r, r.choice([4, 9, 30, 52])) + f" {k}" for k in range(30)]
    texts, groups = {}, {}
    for g in range(80):
        lines = [line(r, 12) for _ in range(12)] + r.sample(pool, 3)
        for _ in range(r.choice([1, 1, 1, 4, 30 if g == 7 else 1])):
            texts[len(texts)] = "\n".join(lines)
            groups[len(texts) - 1] = g
    expected = brute(texts, groups)
    assert expected != texts and cleaned(spark, texts) == expected
    monkeypatch.setattr(line_templates.near_copies, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([*texts.items(), (0, None), (None, pool[0]), (1, "")], "doc_id long, text string").selectExpr("doc_id", "text", "text AS _own", "doc_id AS _id", "1 AS _row")
    got = line_templates.drop_recurring_lines(docs)
    assert got.columns == docs.columns
    found = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert found == sorted([*expected.items(), (0, None), (None, pool[0]), (1, "")], key=str)
