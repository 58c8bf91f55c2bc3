import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ridgeline.llm import bpe, mixing, quality, secret_scan, simhash
from ridgeline.session import settle

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(settle(stage(spark, out[-1], DIR)))
    return out


def test_columns_and_order(steps):
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_each_stage_against_its_own_input(spark, steps):
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = quality.classify(steps[0], labels, host=F.col("source"), path=F.col("lang")).filter("kept")
    assert ids(steps[1]) == ids(kept) and 0 < steps[1].count() < steps[0].count()
    near = simhash.similar_documents(steps[1]).filter("doc_id = component_id")
    assert ids(steps[2]) == ids(near) and steps[2].count() < steps[1].count()
    assert steps[3].count() == steps[2].count()
    scanner = secret_scan.Scanner()
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    after = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    found = {i for i, t in before.items() if scanner.spans(t)}
    assert found and all((before[i] != after[i]) == (i in found) for i in before)
    assert not any(s for t in after.values() for s in scanner.spans(t))
    p = {r[0]: r[1] for r in mixing.probabilities(steps[3], source=F.col("source"), lang=F.col("lang"), tokens=mixing.word_tokens(F.col("text"))).select("row.doc_id", "p").collect()}
    u = {r[0]: r[1] for r in steps[3].select("doc_id", mixing.uniform(F.col("doc_id"))).collect()}
    assert ids(steps[4]) == {i for i in p if u[i] < p[i]}


def test_tokens(steps):
    with open(public_tokenizers.path(cp.TOKENIZER), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == len(text) and all(r["ids"] == enc.encode_ordinary(text[r["doc_id"]]) for r in rows)


def test_one_of_each_goes_by_text_and_id(spark):
    """Texts decide, not ids: an id's other text stays, a repeated row stays once, null ids stay."""
    x = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    y, long = "quite another text of some nine or ten words here", " ".join(f"w{i}" for i in range(3000))
    near = x + " phi"
    rows = [(3, x), (5, x), (5, y), (8, near), (7, y), (3, x), (3, x.upper()), (None, x), (None, x), (20, None), (21, ""), (21, None), (30, long), (29, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in cp.one_of_each(spark, docs, "").collect()]
    first = min((x, x.upper()), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted(kept, key=str) == sorted([(3, first), (5, y), (None, x), (None, x), (20, None), (29, long + " more")], key=str)
    assert cp.one_of_each(spark, docs.filter("false"), "").count() == 0


def test_run_gives_the_same(spark, steps):
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert rows(cp.run(spark, DIR)) == rows(steps[-1])


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    some = docs.limit(5).union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None), (-1, "", None, "s", 0)], docs.schema))
    for start in (docs.filter("false"), some):
        now = start
        for _, stage in cp.STAGES:
            now = settle(stage(spark, now, DIR))
        assert now.count() <= start.count()
