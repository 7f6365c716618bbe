import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from rollbook.llm import bpe, decontaminate, quality, secrets, simhash
from rollbook.llm.frames import keep

from ..conftest import DATA
from .test_decontaminate import plain as leaks
from .test_simhash import expected as groups


def test_stages_against_plain_versions(spark, docs):
    """Each stage against a plain version on what the stage before kept; the model's verdicts are taken as they are."""
    rows = docs.collect()
    columns, previous = docs.columns, docs
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = held.get("rows", rows)
        previous = keep(stage(spark, previous, DATA), "stage")
        held = {"rows": previous.collect()}
        ids = [r["doc_id"] for r in held["rows"]]
        if name == "quality classifier":
            model = quality.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
            assert sorted(ids) == sorted(d for d, s in scores.items() if s >= 0.7)
        elif name == "simhash near-dedup":
            assert sorted(ids) == sorted({c for _, _, c in groups([(r["doc_id"], r["text"]) for r in before])})
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            bad = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in before], items)}
            assert sorted(ids) == sorted(r["doc_id"] for r in before if r["doc_id"] not in bad)
        elif name == "secret scans":
            clean = {r["doc_id"] for r in secrets.digests(secrets.find_secrets(spark.createDataFrame(before))).collect() if not r["spans"]}
            texts = {r["doc_id"]: r["text"] for r in before}
            assert sorted(ids) == sorted(texts) and all((r["text"] == texts[r["doc_id"]]) == (r["doc_id"] in clean) for r in held["rows"])
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            want = {(r["doc_id"], len(library.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before}
            assert {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in held["rows"]} == want
            break
        assert previous.columns == columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, held["rows"]))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA)
            assert out.count() <= table.count() and (name == corpus_pipeline.STAGES[-1][0] or out.columns == table.columns)
    assert decontaminate.WORDS == 5 and simhash.DISTANCE == 4
