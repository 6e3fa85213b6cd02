"""Conversations, archives and the pipeline."""

import gzip
import hashlib
import io

from pyspark.sql import functions as F

import corpus_pipeline
from jobscope.llm import chat, components, jaccard, warc
from jobscope.llm.common import staged


def test_snapshots_collapse(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),  # starts 2
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"),  # as 2
        (4, 5, "user", "hi"), (4, 7, "assistant", "other"), (4, 7, "assistant", "other"),  # a repeated row counts once
        (5, 0, None, None), (6, 0, None, ""), (None, 0, "user", "lost"), (7, None, "user", "x" * 100_000),
        (8, 0, "userh", "i"), (9, 1, "user", "b"), (9, 1, "user", "a"),  # a tie is ordered by text
    ]
    turns = spark.createDataFrame([(*x, "y", 1) for x in rows], "conv_id long, turn long, role string, text string, hash_a string, n_turns int")
    got = {x.conv_id: x for x in chat.format_chats(turns.repartition(3)).collect()}
    assert set(got) == {2, 4, 5, 6, 7, 8, 9} and got[2].n_copies == 2 and got[2].n_turns == 3 and got[4].n_turns == 2
    assert got[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got[5].rendered == got[6].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[9].rendered.index("\na<") < got[9].rendered.index("\nb<")
    assert chat.format_chats(turns.where("false")).count() == 0


def test_archives(spark, tmp_path):
    page = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a/x y", page), (3, "http://b/", page), (9, None, page), (1, "u", "tiny"), (2, "u", "tiny"), (7, "u", None), (None, "http://n\r\nX: y", page), (4, "l", "z" * 400_000), (3, "http://b/", page)]
    pages = spark.createDataFrame([(*x, "d", "r") for x in rows], "page_id long, url string, html string, digest string, row string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages.repartition(3), path)
    got = warc.assemble(staged(warc.read_records(spark, path), "records")).collect()
    assert len(got) == len(rows) and all(x.request and x.metadata and x.response.verified for x in got)
    by = {}
    for x in got:
        by.setdefault(x.page_id, []).append(x.response)
    digest = hashlib.sha256(page.encode()).hexdigest()
    assert all((x.type, x.refers_to, x.payload_digest, x.payload_bytes) == ("revisit", 3, digest, len(page.encode())) for k in (5, 9, None) for x in by[k])
    assert [x.type for x in by[3]] == ["response", "response"] and by[3][0].payload == page.encode()
    assert by[1][0].type == by[2][0].type == "response" and by[7][0].payload_bytes == 0 and by[4][0].payload_bytes == 400_000
    files = list((tmp_path / "w").glob("part-*"))
    whole = [h["warc-type"] for f in files for h, _ in warc.parse(io.BufferedReader(gzip.open(f)))]  # any reader of gzip reads them
    assert len(whole) == 3 * len(rows) and set(whole) == {"request", "response", "revisit", "metadata"}
    members = [x for f in files for x in f.read_bytes().split(warc.BETWEEN) if x]
    assert len(members) == len(whole) and all(gzip.decompress(x).startswith(b"WARC/1.1") for x in members)
    warc.write_archives(pages.where("false"), f"file://{tmp_path}/none")
    assert warc.assemble(warc.read_records(spark, f"file://{tmp_path}/none")).count() == 0


def test_large_pages_and_archives_cut_between_records(spark, tmp_path):
    big = "".join(chr(32 + (k * k) % 90) for k in range(5000)) * 10_000  # 50 MB
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k} " + "é" * (k % 400)) for k in range(3000)], "page_id long, url string, html string")
    pages = pages.union(spark.createDataFrame([(5000, "http://big/", "x")], pages.schema).withColumn("html", F.repeat(F.lit(big[:5000]), 10_000)))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = warc.read_records(spark, path, payloads=False)
        assert got.rdd.getNumPartitions() > 8
        found = {x.page_id: x.response for x in warc.assemble(staged(got, "records")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 3001 and found[5000].payload_bytes == len(big) and found[5000].verified
    assert all(found[k].payload_digest == hashlib.sha256(f"<p>{k} {'é' * (k % 400)}".encode()).hexdigest() for k in range(3000))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200), (300, 250)] + [(500 + k, 400) for k in range(30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {k: 0 for k in range(41)}.items() <= got.items() and got[100] == got[95] == got[90] == 90 and got[201] == 200 and got[300] == 250 and got[529] == got[400] == 400
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, given = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = given
        given = staged(stage(spark, before, d), "t")
        assert k == 4 or given.columns == columns
        assert given.join(before, "doc_id", "left_anti").count() == 0
        if k == 0:
            assert given.count() == before.where(F.col("text").rlike(r"\p{L}")).count()
        if k == 1:
            linked = jaccard.link(before)
            assert given.count() == linked.where("n_shingles > 0").select("component_id").distinct().count() + linked.where("n_shingles = 0").count()
        if k == 3:
            assert given.count() == before.count() and given.where(F.col("text").rlike(r"@mail[0-9]\.example")).count() == 0
    assert {"doc_id", "text", "source", "target", "taken"} <= set(given.columns)
    assert corpus_pipeline.run(spark, d).count() == given.count()
