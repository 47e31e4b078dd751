import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import chunking, costs, evidence, index, retrieval, tools
from skein.streaming import state


@given(st.text(alphabet="ab .\n", max_size=300), st.integers(20, 60))
@settings(max_examples=200, deadline=None)
def test_recursive_split_covers_the_text(text, size):
    chunks = chunking.recursive_split(text, size, 0)
    assert all(len(c) <= size for c in chunks)
    assert "".join("".join(chunks).split()).replace(".", "") == "".join(text.split()).replace(".", "")


def test_recursive_split_overlap_and_edges():
    assert chunking.recursive_split("", 10) == [] == chunking.recursive_split("   ", 10)
    out = chunking.recursive_split("one two three four five six", 12, 20)
    assert out[1].startswith(" ".join(out[0].split()[-2:]))
    assert chunking.recursive_split("aa bb\n\ncccccccccccc dd", 8, 0, pending=True) == ["aa bb", "cccccccc", "cccc", "dd", "aa bb"]
    assert chunking.recursive_split("aa bb\n\ncccccccccccc dd", 8, 0) == ["aa bb", "cccccccc", "cccc", "dd"]
    assert chunking.page_split(["p" * 60, "q " * 40], "", 10, 0)[0] == "p" * 10 and chunking.page_split([], "abc", 10) == ["abc"]


def test_rrf_is_a_ranking_per_query(spark):
    lists = spark.createDataFrame([(1, "a", 10, 1, 0.6), (1, "a", 11, 2, 0.6), (1, "b", 11, 1, 0.4), (1, "b", 12, 2, 0.4)], "query_id int, list string, key int, rank int, weight double")
    got = {r["key"]: r["rrf_rank"] for r in retrieval.rrf(lists).collect()}
    assert got == {11: 1, 10: 2, 12: 3}


def test_bm25_fills_up_with_zero_scores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple pie"), (2, None), (3, ""), (4, "apple apple")], "doc_id int, text string")
    q = spark.createDataFrame([(7, "apple"), (8, "nothing here")], "query_id int, q string")
    got = index.lexical(index.build(docs, str(tmp_path / "i"), "doc_id", "text", None), q, 3).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 8] == [1, 2, 3]
    assert len([r for r in got if r["query_id"] == 7]) == 3
    none = index.build(docs.limit(0), str(tmp_path / "none"), "doc_id", "text", None)
    assert index.lexical(none, q, 3).count() == 0 and index.lexical(none, q.withColumn("grp", F.lit(0)), 3, grouped=True).count() == 0


def test_grouped_search_sees_its_own_group(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple pie", 0), (2, "apple", 1), (3, "pie pie", 1), (4, "x", None)], "id long, content string, project_id int")
    i = index.build(docs, str(tmp_path / "i"))
    q = spark.createDataFrame([(7, "apple", 0), (8, "pie", 1)], "query_id long, q string, grp long")
    assert sorted((r["query_id"], r["id"]) for r in index.lexical(i, q, 5, grouped=True).collect()) == [(7, 1), (8, 2), (8, 3)]
    whole = index.lexical(i, q.drop("grp"), 5)
    assert whole.count() == 8 and i.sizes.where("grp IS NULL").count() == 1
    plain = index.build(docs, str(tmp_path / "plain"), "id", "content", None)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, index.lexical(plain, q.drop("grp"), 5).collect()))


def test_vector_top_k_in_blocks_equals_one_block(spark):
    v = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(40)], "id long, v array<float>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "v")
    one, many = (sorted(map(tuple, retrieval.vector_top_k(v, q, 3, block=b).collect())) for b in (100, 2))
    assert one == many and len(one) == 12


def test_back_off_keeps_all_where_nothing_matches(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id int, s string")
    assert sorted(map(tuple, retrieval.with_back_off(rows, F.col("s") == "a").collect())) == [(1, "a"), (2, "b")]


def test_scan_of_each_type(spark):
    samples = {"openai_api_key": "sk-" + "a1" * 12, "private_key_header": "-----BEGIN RSA PRIVATE KEY-----", "password_field": "password: hunter22", "connection_string": "mysql://u:p@h", "aws_access_key": "AKIA" + "A1" * 8, "ssn": "123-45-6789", "aadhaar": "1234 5678 9012", "credit_card": "1234-5678-9012-3456", "phone_number": "9876543210", "email_address": "a@b.org"}
    df = spark.createDataFrame(list(samples.items()), "kind string, text string")
    for r in df.select("kind", chunking.redact(F.col("text")).alias("red"), *chunking.finding_counts(F.col("text"))).collect():
        assert r[r["kind"]] == 1 and "[REDACTED:" in r["red"]


def test_delta_is_idempotent(spark):
    new = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "document_id int, idx int, chunk string")
    old = new.select("document_id", "idx", F.sha2("chunk", 256).alias("content_hash"))
    assert {r["status"] for r in chunking.chunk_delta(new, old).collect()} == {"unchanged"}


def test_agent_is_bounded(spark):
    p = spark.createDataFrame([(1, "a", "semantic"), (2, "b", "hybrid")], "query_id int, q string, strategy string")
    got = tools.agent(p, lambda df, _: df.select("query_id", F.when((F.col("query_id") == 1) & (F.col("strategy") == "hybrid"), 0.9).otherwise(0.1).alias("confidence"))).collect()
    assert {(r["query_id"], r["action"], r["attempts"]) for r in got} == {(1, "generate", 2), (2, "refuse", 3)}


def test_tools_check_roles(spark):
    with pytest.raises(PermissionError):
        tools.call(spark, "/root/testdata/sf0.001", "client", "get_document_sources")
    assert tools.call(spark, "/root/testdata/sf0.001", "admin", "get_document_sources", limit=3).count() == 3
    for args in ({"limit": 0}, {"limit": "3"}, {"other": 1}, {"limit": True}):
        with pytest.raises(ValueError):
            tools.call(spark, "/root/testdata/sf0.001", "admin", "get_document_sources", **args)
    assert tools.answer(spark, "/root/testdata/sf0.001", "client", "nothing") == {"ok": False, "content": "no tool named nothing"}
    assert len(tools.answer(spark, "/root/testdata/sf0.001", "client", "search_documents", question="the", top_k=2)["content"]) == 2
    assert tools.call(spark, "/root/testdata/sf0.001", "admin", "get_active_rag_config").count() == 1


def test_gate_values(spark):
    one = spark.createDataFrame([(1, 5, 1, 20.0, "t", "a.pdf", None)], "query_id int, id int, rank int, score double, text string, filename string, age_days int")
    r = evidence.confidence(one).first()
    assert r["best"] == pytest.approx(0.5 + 0.1 + 0.16 + 0.05) and r["passed"]


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    q = state.windowed(state.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == src.count()
    docs = spark.createDataFrame([(1, "mail a@b.org now. Then stop."), (2, "x. y.")], "document_id int, content string")
    docs.write.parquet(str(tmp_path / "docs"))
    s = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    state.ingest(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and any("[REDACTED:EMAIL_ADDRESS]" in r["chunk"] for r in got)


def test_cached_answers_release_state(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:50:00"), ("a", "2024-01-01 03:00:00"), ("b", "2024-01-01 01:00:00"), ("a", "2024-01-01 03:59:59")]
    d = spark.createDataFrame(rows, "key string, t string").select("key", F.col("t").cast("timestamp").alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set(*state.STATE_STORE)
    try:
        q = state.cached_answers(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r["key"], r["ts"].strftime("%H:%M")): r["hit"] for r in spark.sql("SELECT * FROM hits").collect()}
    finally:
        spark.conf.unset(state.STATE_STORE[0])
    assert got == {("a", "00:00"): False, ("a", "00:50"): True, ("a", "03:00"): False, ("a", "03:59"): True, ("b", "01:00"): False}


def test_session_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = state.session_counts(state.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM sc").first()[0] == src.count()


def test_alike_texts_against_all_pairs(spark):
    import itertools
    import math
    import random

    r = random.Random(3)
    texts = sorted({" ".join(r.choice(["the", "of", "cat", "dog", "red", "sun", f"w{r.randint(0, 9)}"]) for _ in range(r.randint(1, 6))) for _ in range(120)})
    vec, n = [], len(texts)
    df = {w: sum(w in t.split() for t in texts) for t in texts for w in t.split()}
    for t in texts:
        ws = t.split()
        v = {w: ws.count(w) / len(ws) * (math.log((n + 1) / (df[w] + 1)) + 1) for w in ws}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec.append({w: x / norm for w, x in v.items()})
    want = {(i, j): round(s, 6) for i, j in itertools.combinations(range(n), 2) if round(s := sum(x * vec[j].get(w, 0) for w, x in vec[i].items()), 6) >= 0.75}
    got = costs.alike(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    assert {(x["a"], x["b"]): x["sim"] for x in got} == pytest.approx(want) and len(want) > 20


def test_keywords_in_blocks_equal_one_block(spark):
    docs = spark.createDataFrame([(1, 0, "The Cathedral opens", "a"), (2, 0, "a cat sat", "b"), (3, 1, "cat", "c"), (4, 0, None, "d")], "id long, grp long, text string, source string")
    q = spark.createDataFrame([(10, 0, ["cat", "cat", "xyz"]), (11, 1, ["cat", "open"]), (12, 0, ["open"]), (13, 0, [])], "query_id long, grp long, keywords array<string>")
    one, many = (sorted(map(tuple, evidence.keyword_matches(docs, q, block=b).select("query_id", "id").collect())) for b in (100, 1))
    assert one == many == [(10, 1), (10, 2), (11, 3), (12, 1)]
    got = {r["query_id"]: tuple(r)[1:] for r in evidence.absence(docs, q).collect()}
    assert got[10] == (3, 2, 2, "1,2") and got[13] == (3, 0, 0, "") and got[11] == (1, 1, 1, "3")
    assert evidence.keyword_matches(docs, q.where("query_id = 13")).count() == 0


def test_sinks_and_tables(spark, tmp_path):
    from skein.sources import store

    root = str(tmp_path / "db")
    store.create_tables(spark, root)
    store.create_tables(spark, root)
    assert store.stored(spark, root, "query_log").count() == 0
    store.append(spark.createDataFrame([(1, 2, 9)], "id int, project_id int, other int"), root, "query_log")
    store.append(spark.createDataFrame([(2,)], "id int"), root, "query_log")
    r = store.stored(spark, root, "query_log").orderBy("id").collect()
    assert [(x["id"], x["project_id"], x["model_used"]) for x in r] == [(1, 2, None), (2, None, None)]
    store.clear(spark, root, "query_log")
    assert store.stored(spark, root, "query_log").count() == 0


def pdf(*pages, packed=True):
    """A small file with these content streams."""
    import zlib

    out, n = b"%PDF-1.4\n", 10
    for content in pages:
        data = zlib.compress(content) if packed else content
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n%d 0 obj << /Length %d %s >> stream\n%s\nendstream endobj\n" % (n, n + 1, n + 1, len(data), b"/Filter /FlateDecode" if packed else b"", data)
        n += 2
    return out + b"1 0 obj << /Type /Pages >> endobj\n%%EOF"


def test_uploads_are_decoded(spark, tmp_path):
    from skein.sources import pdf as reader

    one, two = b"BT (Hello \\(PDF\\) ) Tj [(wor) -20 (ld)] TJ 0 -14 Td (caf\\351) Tj ET", b"BT <FEFF00E9> Tj ET"
    assert reader.pdf_pages(pdf(one, two)) == ["Hello (PDF) world\ncaf\u00e9", "\u00e9"] == reader.pdf_pages(pdf(one, two, packed=False))
    assert reader.pdf_pages(b"no pdf") == [] and reader.pdf_pages(pdf(b"")) == [""]
    (tmp_path / "a.txt").write_bytes("héllo".encode() + b"\xff")
    (tmp_path / "b.md").write_bytes(b"x")
    (tmp_path / "c.PDF").write_bytes(pdf(one, two))
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in reader.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "héllo\ufffd", "b.md": "x", "c.PDF": "Hello (PDF) world\ncaf\u00e9\n\u00e9\n"}


def test_index_maintenance_by_batches(spark, tmp_path):
    docs = lambda *x: spark.createDataFrame(list(x), "document_id int, content string").coalesce(1)
    src, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    docs((1, "One sentence here. Two."), (2, "stays")).write.parquet(src)
    run = lambda: state.maintain(spark.readStream.schema("document_id int, content string").parquet(src), target, cp).awaitTermination()
    run()
    docs((1, "Another sentence."), (3, "new")).write.mode("append").parquet(src)
    run()
    got = {r["document_id"]: r["chunk_version"] for r in spark.read.parquet(f"{target}/v1").collect()}
    assert got == {1: 2, 2: 1, 3: 1} and spark.read.parquet(f"{target}/v0").count() == 2


def test_constraints_back_off(spark):
    rows = spark.createDataFrame([(1, 1, "alpha beta", "x.pdf"), (1, 2, "beta", "hr.md"), (2, 3, "alpha", "x.md"), (3, 4, "beta", "y.md"), (3, 5, None, None)], "query_id int, id int, text string, source string")
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.expr("cast(array() as array<string>)")
    keep = lambda *a: sorted(r["id"] for r in retrieval.apply_constraints(rows, *a).collect())
    assert keep(arr("alpha"), arr(), arr()) == [2, 3, 4, 5] and keep(arr(), arr("hr"), arr()) == [2, 3, 4, 5]
    assert keep(arr(), arr("beta"), arr("pdf")) == [1, 3, 4] and keep(arr(), arr(), arr()) == [1, 2, 3, 4, 5]


def test_sentence_compression_keeps_one(spark):
    rows = spark.createDataFrame([(1, 1, 1, "zebra", "one two three four. five six seven eight."), (1, 2, 2, "zebra", ""), (1, 3, 3, "zebra", "the zebra runs very fast. nothing else is said here.")], "query_id int, id int, rank int, q string, chunk string")
    got = {r["id"]: r for r in evidence.compress(rows, "q", "chunk", least_sentences=1).collect()}
    assert got[2]["compressed"] == "" and got[2]["kept"] == 0 and "zebra" in got[3]["compressed"] and got[1]["kept"] >= 1
