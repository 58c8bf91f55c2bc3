import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import bpe, chat, mixing, quality, secret_scan, simhash, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, path string, p string, s_source string"


def odd(spark, texts):
    """Documents with the given texts, extra columns of clashing names, a null id and a repeated row."""
    rows = [(i, t, "en", None, 1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", None, "s", None, None, None, None, None)], DOCS)


TEXTS = ["one two three four five", None, "", " \n\t ", "Ünïcode Ελληνικά 漢字 😀 words here", "a" * 300_000, "x y " * 50_000, "one two three four five"]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        data = f.read()
    ranks = bpe.parse_ranks(data)
    return bpe.coder_for(data, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(coder, text):
    own, other = coder
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_bpe_any_bytes(coder, piece):
    own, other = coder
    assert own.encode_piece(piece) == other._encode_single_piece(piece)


def test_bpe_edits(coder):
    own, other = coder
    rng = random.Random(4)
    parts = ["a", " ", "\n", "é", "the", "ing", "0", "漢", "'s", "  ", "_", "!", "aaaa", "ooooo"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        e = bpe.EditableEncoding(own, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = a if rng.random() < 0.5 else min(len(text), a + 5)
            new = "".join(rng.choices(parts, k=rng.randint(0, 4)))
            text = text[:a] + new + text[b:]
            e.replace(a, b, new)
            assert e.ids() == other.encode_ordinary(text)
    e = bpe.EditableEncoding(own, "some longer words " * 200)
    steps = e.steps
    e.append("more")
    assert e.steps - steps < 40


def test_bpe_frame(spark, coder):
    docs = odd(spark, TEXTS)
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    got = out.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        if len(text) < 100_000:
            want = coder[1].encode_ordinary(text)
            assert r["ids"] == want
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode(docs.filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_long_text_in_groups(coder, monkeypatch):
    text = "some words, 123 and more\n" * 50
    want = coder[0].digest(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "LONG_GROUP", 7)
    assert coder[0].digest(text) == want


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, radius=4):
    fp = np.array(fps, np.uint64)
    f = simhash.Forest(len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
    f.union(i, j)
    roots = f.roots(np.arange(len(fp)))
    return {i: min(ids[k] for k in np.nonzero(roots == roots[n])[0]) for n, i in enumerate(ids)}


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(r["text"]) for r in rows]
    assert all(got[r["doc_id"]]["fingerprint"] == f"{f:016x}" for r, f in zip(rows, fps, strict=True))
    want = brute_groups([r["doc_id"] for r in rows], fps)
    assert {k: v["component_id"] for k, v in got.items()} == want


def test_simhash_edges(spark):
    got = simhash.near_duplicates(odd(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) + 2
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[0] == of[7] == 0 and of[None] is None
    assert all(r["fingerprint"] == f"{brute_fingerprint(TEXTS[r['doc_id']]):016x}" for r in got if r["doc_id"] is not None)
    assert simhash.near_duplicates(odd(spark, ["a"]).filter("false")).count() == 0


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_vantage_point_shards_lose_no_pair(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    near = x[:500].copy()
    for k in range(500):
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            near[k] ^= np.uint64(1) << np.uint64(b)
    ball = x[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    x = np.unique(np.concatenate((x, near, ball)))
    rng.shuffle(x)
    want = simhash.Forest(len(x))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    want.union(i, j)
    got = simhash.Forest(len(x))
    for _, home, guest in simhash.deal(simhash.fit_tree(x[:256], depth), x, 4):
        at = np.concatenate((home, guest))
        got.union(at, at[simhash.link(x[at], len(home), 4)])
    every = np.arange(len(x))
    assert (got.roots(every) == want.roots(every)).all()


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("shard", [1 << 15, 60])
def test_similar_documents_against_exact_similarity(spark, monkeypatch, shard):
    """In one shard a band, and in bands divided by the tree."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert set(of) == set(rows)
    ids, best, missed, near = sorted(rows), dict.fromkeys(rows, 0.0), 0, 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(rows[a]) * 0.7 <= len(rows[b]) <= len(rows[a]) / 0.7:
                both = len(rows[a] & rows[b])
                j = both / (len(rows[a]) + len(rows[b]) - both)
                best[a], best[b] = max(best[a], j), max(best[b], j)
                near += j >= 0.8
                missed += j >= 0.8 and of[a] != of[b]
                assert j < 0.86 or of[a] == of[b]
    assert near > 20 and missed <= 0.05 * near
    assert all(best[i] > 0.7 for i, c in of.items() if c != i)


def test_similar_documents_edges(spark):
    got = simhash.similar_documents(odd(spark, [*TEXTS[:5], "a", "a b"])).collect()
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == 9 and of[1] == of[2] == of[3] == 1 and of[0] == 0 and of[5] == 5 and of[6] == 6 and of[None] is None
    assert simhash.similar_documents(odd(spark, ["a"]).filter("false")).count() == 0


def test_similar_documents_by_sets_of_shingles(spark, monkeypatch):
    """Repeats of a line neither link texts nor part them; short texts link from 0.8 on; chunks of a component all meet."""
    monkeypatch.setattr(simhash, "CHUNK", 2000)
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    line = words("line", 10) + " "
    texts = [line * 10 + words(f"own{k}x", 104) for k in range(40)]
    texts += [words("same", 100), words("same", 100).upper(), words("four", 8), words("four", 9)]
    base = " ".join(["r"] * 5 + [words("w", 24)] * 2)
    texts += [base, base + " " + " ".join([words("w", 24)] * 10)]
    long = words("long", 500).split()
    texts += [" ".join(long[:k] + [f"new{k}"] + long[k + 1 :]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert [of[k] for k in range(40)] == list(range(40))
    assert of[41] == 40 and of[43] == 42 and of[45] == 44
    assert {of[k] for k in range(46, 86)} == {46}


def test_simhash_of_an_id_with_several_texts(spark):
    a, b = "one two three four five six seven", "quite other words stand in this one here"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (12, b + " " + a)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (12, 12)]


def brute_secrets(text):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), m.end(), "assign") for m in a.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], secret_scan.KINDS.index(x[2])))


def test_secret_spans_match_brute_force():
    scanner, rng = secret_scan.Scanner(), random.Random(2)
    parts = ["face", "00000000", "aB", "password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", '"', "AKIA", "abcdef0123", "ABCDEFG123", "deadbeef", "İ", "\u212a", " ", "é", "x", "_", ".", "ſecret", "AKIAAKIA"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert [s for s in scanner.spans(text) if s[2] != "token"] == brute_secrets(text)


def test_secrets_in_very_long_texts():
    text = "x 0a " * 60_000 + "Password = 'abcdefghijklmn'" + "0123456789abcdef" * 20_000 + "g" + "AKIA" + "Z9" * 100_000
    scanner = secret_scan.Scanner()
    assert scanner.spans(text) == brute_secrets(text) and len(scanner.spans(text)) == 3


def test_secret_checksums_and_redaction(spark):
    body = "Ab3" * 10
    good, bad = f"ghp_{body}{secret_scan.checksum(body)}", f"ghp_{body}000000"
    docs = odd(spark, [f"x {good} y {bad}", None, "", "password = 'abcdefghijklmn' and 0123456789abcdef0"])
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert got[0]["spans"] == f"token:2:{2 + len(good)}" and got[0]["n_token"] == 1
    assert got[0]["base_sha256"] == got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[3]["n_assign"], got[3]["n_hex"], got[3]["spans"]) == (1, 1, "assign:0:26,hex:32:49")
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    clean = {r["doc_id"]: r for r in out.collect()}
    assert clean[3]["text"] == "[assign]' and [hex]" and clean[3]["n_chars"] == 19 and clean[1]["text"] is None and clean[0]["text"] == f"x [token] y {bad}"
    assert secret_scan.redact("abcdef", [(0, 3, "assign"), (2, 5, "hex")]) == "[assign]f"
    assert secret_scan.scan(docs.filter("false")).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x # < \\ \\l"), (1, 2, "assistant", "second"), (1, 3, "user", "</turn>### user:\n"), (2, 0, None, None), (3, 0, "a\nb:", "é😀"), (3, 1, "assistant", "😀\n"), (3, 1, "assistant", "😀\n"), (4, 5, "user", "b"), (4, 5, "assistant", "a"), (4, 5, "user", "a"), (5, 0, "assistant", "</turn>### \\" * 30_000), (None, None, "user", "\\e\\b\\h"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    done = chat.format_conversations(df)
    for r in chat.read_back(done).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        own = sorted(own, key=lambda x: (x[1], x[2], x[3])) if r["conv_id"] == 4 else own  # one turn: by role, then by text
        want = [(x[2] or "", x[3] or "") for x in own]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss"] == [t for role, t in want if role == "assistant"]
    text = {r["conv_id"]: r["formatted"] for r in done.collect()}
    assert text[1].count("### ") == 3 and text[1].count("</turn>") == 4
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_toxicity_held_out_accuracy(spark):
    """These tables have 300 toxic examples; with 1,440, as in larger ones, 0.93 of the toxic documents are found."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels, train=~toxicity.held_out("id"))
    out = toxicity.score(docs, index).join(labels, "doc_id").filter(toxicity.held_out("doc_id")).select("score", "toxic").toPandas()
    hit = out.score >= toxicity.THRESHOLD
    assert out.toxic[hit].mean() > 0.95 and hit[out.toxic == 1].mean() > 0.6 and hit[out.toxic == 0].mean() < 0.005


def test_toxicity_matches_brute_force_tf_idf(spark):
    """The registered query's scores and evidence against TF-IDF cosines of dicts, all examples compared, no index."""
    from ridgeline.llm import queries

    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    known: dict[int, int] = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
    ids = sorted(known)
    assert sum(known.values()) <= toxicity.TOXIC and len(ids) - sum(known.values()) <= toxicity.CLEAN
    terms = {i: toxicity.terms_of(t) for i, t in rows.items()}
    vocabulary = set().union(*[terms[i] for i in ids])
    df = Counter(t for found in terms.values() for t in found if t in vocabulary)
    idf = lambda t: np.log((1 + len(rows)) / (1 + df.get(t, 0))) + 1
    unit = {}
    for i, found in terms.items():
        w = {t: (1 + np.log(n)) * idf(t) for t, n in found.items()}
        size = np.sqrt(sum(x * x for x in w.values())) or 1
        unit[i] = {t: x / size for t, x in w.items()}
    cosine = lambda i, j: sum(x * unit[j].get(t, 0.0) for t, x in unit[i].items())
    base = sum(known.values()) / len(ids)

    def vote(cos: dict[int, float]) -> float:
        top = sorted(cos.items(), key=lambda x: -x[1])
        rest = top[toxicity.NEIGHBOURS][1] if len(top) > toxicity.NEIGHBOURS else 0.0
        w = [(c - rest, known[i]) for i, c in top[: toxicity.NEIGHBOURS]]
        return (sum(c * y for c, y in w) + toxicity.PRIOR * base) / (sum(c for c, _ in w) + toxicity.PRIOR)

    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, d).collect()}
    assert len(got) == len(rows)
    cos = {i: {j: cosine(i, j) for j in ids} for i in list(rows)[:250]}
    for i, found in cos.items():
        near = sorted(found.values(), reverse=True)[: toxicity.SHOWN]
        assert [e["similarity"] for e in got[i]["evidence"]] == pytest.approx([c for c in near if c > 1e-12], abs=1e-9)
        assert all(found[e["doc_id"]] == pytest.approx(e["similarity"], abs=1e-9) and known[e["doc_id"]] == e["toxic"] for e in got[i]["evidence"])
    # The curve is one increasing logistic of the vote for all texts.
    raw, z = np.array([vote(f) for f in cos.values()]), np.array([np.log(got[i]["score"] / (1 - got[i]["score"])) for i in cos])
    b, a = np.polyfit(raw, z, 1)
    assert b > 0 and np.allclose(a + b * raw, z, atol=1e-6)


def test_toxicity_terms_of_a_batch_are_those_of_each_text():
    texts = ["", "ab 12_x", "Straße straßen straßen ünïcode", "stemming stemmed stems stem " * 3, *TEXTS[:5]]
    texts = [t or "" for t in texts] + ["word " * 50 + "longest longer"]
    vocabulary = sorted(set().union(*[toxicity.terms_of(t) for t in texts[1:-2]]))
    at, term, n = toxicity.Terms(vocabulary).entries(texts)
    for i, t in enumerate(texts):
        want = toxicity.terms_of(t)
        assert {vocabulary[k]: c for k, c in zip(term[at == i], n[at == i], strict=True) if k >= 0} == {k: c for k, c in want.items() if k in set(vocabulary)}
        assert sorted(n[(at == i) & (term < 0)]) == sorted(c for k, c in want.items() if k not in set(vocabulary))


def test_toxicity_edges(spark):
    docs, none = odd(spark, TEXTS), spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["score"] == 0.5 and r["evidence"] == [] for r in rows)
    few = spark.createDataFrame([(0, 1), (0, 0), (4, 0), (5, 0), (6, 1), (99, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, few)).collect())
    assert toxicity.score(docs.filter("false"), toxicity.fit(docs.filter("false"), few)).count() == 0


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels, host=F.col("source"), path=F.col("lang"))
    assert out.count() == docs.count()
    held = out.join(labels, "doc_id").filter(toxicity.held_out("doc_id")).toPandas()
    assert held.kept[held.quality == 1].mean() > 0.98 and held.kept[held.quality == 0].mean() < 0.05
    kept = quality.keep_good(docs, labels, host=F.col("source"), path=F.col("lang"))
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in out.filter("kept").select("doc_id").collect()}


def test_quality_matches_a_posterior_by_hand(spark):
    """Sites, priors and scores from the evidence alone, recomputed without Spark over the registered query's rows."""
    from ridgeline.llm import queries

    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, d).collect()}
    site = {r["doc_id"]: (r["source"] or "", r["lang"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang").collect()}
    assert set(got) == set(site)

    def prior(groups: dict) -> tuple[float, float]:
        n, good = {k: len(v) for k, v in groups.items()}, {k: sum(v) for k, v in groups.items()}
        rows = sum(n.values())
        mean = sum(good.values()) / rows
        within = mean * (1 - mean)
        between = (sum(n[k] * (good[k] / n[k] - mean) ** 2 for k in n) - (len(n) - 1) * within) / (rows - sum(x * x for x in n.values()) / rows)
        return mean, min(1e4, max(2.0, within / between - 1)) if between > 0 else 1e4

    hosts, paths = {}, {}
    for i, (host, path) in site.items():
        hosts.setdefault(host, []).append(got[i]["evidence"])
        paths.setdefault((host, path), []).append(got[i]["evidence"])
    mean, of_host = prior(hosts)
    _, of_path = prior(paths)
    odds = lambda p: np.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for i, (host, path) in site.items():
        e, group = got[i]["evidence"], paths[host, path]
        rate = (sum(hosts[host]) + of_host * mean) / (len(hosts[host]) + of_host)
        rate = (sum(group) - e + of_path * rate) / (len(group) - 1 + of_path)
        score = 1 / (1 + np.exp(-(odds(e) + odds(rate) - odds(mean))))
        assert got[i]["site_rate"] == pytest.approx(rate, abs=1e-9) and got[i]["score"] == pytest.approx(score, abs=1e-9)
        assert got[i]["kept"] == (got[i]["score"] >= quality.KEEP)


def test_quality_shrinks_sparse_sites(spark):
    rows = spark.createDataFrame([("big", "a", 0.9)] * 400 + [("big", "b", 0.2)] * 400 + [("big", "c", 0.1)] + [("small", "a", 0.1)], "host string, path string, evidence double")
    known = {(r["s_host"], r["s_path"]): r for r in quality.sites(rows).collect()}
    rate = lambda r: (r["good"] + r["strength"] * r["host_rate"]) / (r["n"] + r["strength"])
    assert rate(known["big", "a"]) == pytest.approx(0.9, abs=0.02) and rate(known["big", "b"]) == pytest.approx(0.2, abs=0.02)
    assert 0.25 < rate(known["big", "c"]) < 0.56 and rate(known["small", "a"]) > 0.2
    out = quality.posterior(rows, quality.sites(rows)).collect()
    assert len(out) == 802 and all(0 < r["score"] < 1 for r in out)


def test_quality_edges(spark, monkeypatch):
    docs, none = odd(spark, TEXTS), spark.createDataFrame([], "doc_id bigint, quality int")
    how = {"host": F.col("source"), "path": F.col("lang")}
    assert quality.classify(docs, none, **how).filter("kept").count() == len(TEXTS) + 2
    assert quality.classify(docs.filter("false"), none, **how).count() == 0
    labels = spark.createDataFrame([(0, 1), (2, 0), (4, 1), (99, 1), (None, 1)], "doc_id bigint, quality int")
    small = sorted(map(str, quality.classify(docs, labels, **how).collect()))
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    assert sorted(map(str, quality.classify(docs, labels, **how).collect())) == small and len(small) == len(TEXTS) + 2


def test_mixing_marginals(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    how = {"source": F.col("source"), "lang": F.col("lang"), "tokens": mixing.word_tokens(F.col("text")), "targets": {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}, "fraction": 0.05}  # so little that no cell is used up
    p = mixing.probabilities(docs, **how).cache()
    want = p.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("p")).alias("t")).collect()
    total = sum(r["t"] for r in want)
    assert {r["lang"]: round(r["t"] / total, 2) for r in want} == {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    assert total / p.agg(F.sum("tokens")).first()[0] == pytest.approx(0.05, abs=0.001)
    assert p.filter("p >= 1").count() == 0
    assert p.agg(*[F.max(F.abs(f"{s}_miss")) for s in mixing.SIDES]).first() == pytest.approx((0, 0, 0), abs=1e-6)
    taken = mixing.mix(docs, **how).agg(F.sum("tokens")).first()[0]
    assert taken / total == pytest.approx(1, abs=0.2)
    local = {(r["source"], r["lang"], r["topic"]): r["p"] for r in p.select("source", "lang", "topic", "p").distinct().collect()}
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    wide = mixing.probabilities(docs, **how, rounds=8).select("source", "lang", "topic", "p").distinct().collect()
    assert all(r["p"] == pytest.approx(local[r["source"], r["lang"], r["topic"]], rel=1e-3) for r in wide)


def test_mixing_where_cells_are_used_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    how = {"source": F.col("source"), "lang": F.col("lang"), "tokens": mixing.word_tokens(F.col("text")), "targets": {"lang": {"en": 0.1, "de": 0.3, "fr": 0.3, "es": 0.3}}}
    p = mixing.probabilities(docs, **how).cache()
    full, given, whole = p.agg(F.count_if(F.col("p") >= 1), F.sum(F.col("tokens") * F.col("p")), F.sum("tokens")).first()
    assert full > 0 and given / whole == pytest.approx(mixing.FRACTION, abs=1e-6)
    # The languages asked for too much give nearly all they have, and the misses say by how much they fall short.
    of = {r["lang"]: r for r in p.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("p")).alias("t"), F.sum("tokens").alias("all"), F.first("lang_miss").alias("miss")).collect()}
    assert all(of[s]["t"] > 0.99 * of[s]["all"] and of[s]["miss"] < 0 for s in ("de", "fr", "es")) and of["en"]["miss"] > 0.1
    assert all(r["miss"] == pytest.approx(r["t"] / given - (0.1 if s == "en" else 0.3), abs=1e-6) for s, r in of.items())


def test_raking_reaches_every_marginal_that_can_be_reached(spark, monkeypatch):
    """Against sums by hand: a value that has too little is used up, the rest of its side goes to the others in proportion."""
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.choice(["t", "u", "v"]), rng.randint(1, 9) * (20 if i % 5 else 1)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, kind string, n bigint")
    whole = sum(r[4] for r in rows)
    have = {v: sum(r[4] for r in rows if r[3] == v) for v in "tuv"}
    targets = {"source": {"a": 1, "b": 3}, "topic": {"t": 0.9, "u": 0.1}}
    how = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("kind"), "tokens": F.col("n"), "targets": targets}
    for cells in (mixing.LOCAL_CELLS, 0):
        monkeypatch.setattr(mixing, "LOCAL_CELLS", cells)
        p = {(r["source"], r["lang"], r["topic"]): r["p"] for r in mixing.probabilities(docs, **how, rounds=25 if cells else 6).collect()}
        given = {v: sum(r[4] * p[r[1], r[2], r[3]] for r in rows if r[3] == v) for v in "tuv"}
        assert given["v"] == 0 and given["t"] == pytest.approx(have["t"], rel=1e-3) and given["t"] + given["u"] == pytest.approx(whole / 2, rel=1e-3)
        assert all(0 <= x <= 1 for x in p.values())


def test_mixing_edges(spark):
    docs = odd(spark, TEXTS)
    how = {"source": F.col("source"), "lang": F.col("lang"), "tokens": mixing.word_tokens(F.col("text"))}
    rows = mixing.probabilities(docs, **how)
    assert rows.count() == len(TEXTS) + 2 and rows.filter("p < 0 or p > 1 or p is null").count() == 0
    assert rows.select("row.*").columns == docs.columns
    assert [r[0] for r in docs.filter("doc_id < 4").orderBy("doc_id").select(mixing.word_tokens(F.col("text"))).distinct().collect()]
    assert mixing.mix(docs.filter("false"), **how).count() == 0
    assert mixing.mix(docs, **how, targets={"lang": {"xx": 1.0}}).count() == 0
