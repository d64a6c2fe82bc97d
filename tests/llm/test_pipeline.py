"""The pipeline against its stages done by brute force on a small table."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np

import corpus_pipeline
from logquarry.llm import mixing, quality, simhash
from logquarry.llm.queries import QUERIES, tokenizer


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import tiktoken

    licence = "Licensed under the public license of this project and its many friends."
    texts = {i: prose(i, 80) + "\n" + prose(1000 + i, 40) + ("\n" + licence if i % 4 == 0 else "") for i in range(120)}
    texts |= {200 + i: texts[1] for i in range(5)}  # exact copies
    texts |= {300 + i: " ".join(w + "###" for w in prose(i, 90).split()) for i in range(30)} | {400: None, 401: "", 402: "short"}
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 300), 0) for i in texts if i % 2 == 0 and i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in texts if i < 300}
    assert set(seen[0]) == clean
    assert {i: r.text for i, r in seen[1].items()} == {i: texts[i].replace("\n" + licence, "") for i in clean}
    assert set(seen[2]) == {i for i in clean if i < 200}
    left = [(i, len(r.text.split()), r.source) for i, r in seen[2].items()]
    sources = sorted({s for _, _, s in left})
    sizes = np.array([sum(n for _, n, s in left if s == x) for x in sources])
    goal = dict(zip(sources, mixing.targets(sizes, np.arange(len(sources)) % 3 + 1.0), strict=True))
    taken = Counter()
    for r in docs.collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - goal[s]) <= 130 for s in sources)  # a document's words: parts round to whole documents

    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((r.doc_id, hashlib.sha256(np.array(library.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_stages_take_odd_rows(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, _row long, _id long, template long, size long, copy long, fp long"
    good = {i: prose(i, 70) for i in range(12)}
    rows = [(i, t, "en", "a", len(t), *[7] * 6) for i, t in good.items()]
    rows += [(0, good[0], "en", "a", len(good[0]), *[7] * 6), (1, prose(99, 70), None, None, None, *[7] * 6), (None, prose(50, 80), "en", None, None, *[None] * 6), (None, prose(51, 80), None, "a", 1, *[7] * 6)]
    rows += [(20, None, None, None, None, *[7] * 6), (21, "", "en", "a", 0, *[7] * 6), (22, " \n", "en", "a", 2, *[7] * 6), (23, prose(60, 30000), "en", "b", 1, *[7] * 6)]
    spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 0, 0), (20, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, names)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString(), name
        docs = spark.createDataFrame(found.collect(), docs.schema)
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name == "near dedup":
            kept = [r.doc_id for r in docs.collect()]
            assert sorted(i for i in kept if i is not None) == [*range(12), 23] and kept.count(None) == 2
    assert corpus_pipeline.tokenize(spark, docs, str(tmp_path)).count() == docs.count() > 0


def test_contract_columns_match_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    rows = con.execute(f"""SELECT doc_id, len({words}), coalesce(list_sum(list_transform({words}, lambda w: length(w))), 0), len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')),
      strlen(coalesce(text, '')), greatest(1, ceil(strlen(coalesce(text, '')) / 64)) * 64 FROM documents ORDER BY doc_id""").fetchall()
    a = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, folder).collect()}
    b = {r.doc_id: r for r in QUERIES["op3_flac"](spark, folder).collect()}
    c = {r.doc_id: r for r in QUERIES["op9_mixing"](spark, folder).collect()}
    assert len(rows) == len(a) == len(b) == len(c)
    for i, n_words, chars, symbols, n_bytes, payload in rows:
        assert (a[i].n_words, a[i].word_chars, a[i].n_symbols) == (n_words, chars, symbols)
        assert (b[i].n_bytes, b[i].payload_bytes) == (n_bytes, payload) and c[i].size == n_words
    sizes = dict(con.execute(f"SELECT source, sum(len({words})) FROM documents GROUP BY source").fetchall())
    sources = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    assert all(c[i].source_size == sizes[sources[i]] for i in c)


def test_every_operator_has_a_query():
    import __spark_entry__ as contract

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in contract.queries() and corpus_pipeline.ORACLE_SQL is None
    assert quality.BASE and simhash.DISTANCE == 3
