"""SimHash near-duplicates, joined exactly by distributed vantage-point trees over Hamming distance.

Distinct fingerprints only take part, each with its smallest id. A top tree, whose vantage points and radii come from a
bounded sample, deals them to shards: a fingerprint's home is the leaf that its distances lead to, and it visits each
other leaf inside whose bounds a fingerprint within the threshold could lie (triangle inequality, so none is missed,
whatever the sample was). Each shard joins its homes with its visitors by a local vantage-point tree and returns a
spanning forest of the links it found, never pairs within a group. Components are then united over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BATCH_BYTES, arrow_map, settle, to_arrow
from .components import components

SEED = 42
#: Distinct fingerprints that the top tree is fitted on (the first by hash); every fingerprint is then dealt by it.
SAMPLE = 4096
#: Fingerprints that a shard should hold as homes.
SHARD = 32_768
#: Homes below which a local tree compares all.
LEAF = 64
#: Comparisons made at once.
BLOCK = 1 << 19
#: Shingles hashed at once.
SHINGLES = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included: a bit is set if over half of the hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), 0
    for raw in _digests(words, width):
        _add_bits(total, np.frombuffer(raw, np.uint8).reshape(-1, 8))
        n += len(raw) // 8
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _digests(words: list[bytes], width: int) -> Iterator[bytes]:
    """Eight bytes for each shingle, repeats included, SHINGLES at a time."""
    import xxhash

    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    ends = starts + sizes
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, n, SHINGLES):
        yield b"".join([digest(line[a:b], SEED) for a, b in zip(first[at : at + SHINGLES], last[at : at + SHINGLES], strict=True)])


def _add_bits(total: np.ndarray, hashes: np.ndarray) -> None:
    """Adds to total how many of the rows of bytes have each bit."""
    ones = np.unpackbits(hashes, axis=1)
    for k in range(0, len(ones), 255):  # so few that bytes hold the sums
        total += ones[k : k + 255].sum(axis=0, dtype=np.uint8)


#: Words of a long fingerprint.
LONG_WORDS = 16
_ODD = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(LONG_WORDS)], np.uint64)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Each 64-bit hash as LONG_WORDS words, by multiplying and mixing."""
    h = hashes[:, None] * _ODD[None, :] + _ODD[None, ::-1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).view(np.uint8)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's distinct shingles in ascending order; no words: none."""
    words = (text or "").encode().lower().split()
    return np.unique(np.frombuffer(b"".join(_digests(words, width)), ">u8").astype(np.uint64)) if words else np.zeros(0, np.uint64)


def long_fingerprint(text: str | None, width: int) -> tuple[int, bytes, bytes]:
    """Number of distinct shingles, a digest of their set, and a SimHash of 64 LONG_WORDS bits; no words: 0 and zero bits."""
    import xxhash

    hashes = shingle_set(text, width)
    total = np.zeros(64 * LONG_WORDS, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        _add_bits(total, _spread(hashes[at : at + SHINGLES]))
    return len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), np.packbits(total * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp (the fingerprint as a signed long). Null and empty texts have fingerprint zero, like any other value."""

    def make():
        def work(cols: dict[str, list]) -> dict[str, list]:
            out = []
            for t in cols["text"]:
                f = fingerprint(t, width)
                out.append(f - (1 << 64) if f >> 63 else f)
            return {"id": cols["id"], "fp": out}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, fp bigint")


def fit_tree(sample: np.ndarray, depth: int) -> list:
    """Nested (point, radius, inside, outside); None is a leaf. Equal distances end a branch, as no radius divides them."""
    if depth == 0 or len(sample) < 8:
        return None
    tries = sample[np.linspace(0, len(sample) - 1, 5).astype(int)]
    far = [np.bitwise_count(sample ^ t) for t in tries]
    k = int(np.argmax([np.var(d) for d in far]))  # a point with spread-out distances prunes most
    d = far[k]
    r = int(np.median(d))
    if not (d > r).any():
        r -= 1
    if not (d <= r).any() or not (d > r).any():
        return None
    return [int(tries[k]), r, fit_tree(sample[d <= r], depth - 1), fit_tree(sample[d > r], depth - 1)]


def deal(tree, fps: np.ndarray, radius: int, *, visit_all: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaf number, indices of its homes and of its visitors.

    Of two fingerprints that a node parts, the outer one visits the inner side, so a pair is met once at least.
    visit_all: there are visitors only, which go wherever a home within the radius may be."""
    number = [0]

    def go(node, home, guest):
        if node is None:
            number[0] += 1
            yield number[0] - 1, home, guest
            return
        point, r, inside, outside = node
        dh, dg = np.bitwise_count(fps[home] ^ np.uint64(point)).astype(np.int16), np.bitwise_count(fps[guest] ^ np.uint64(point)).astype(np.int16)
        yield from go(inside, home[dh <= r], np.concatenate((guest[dg <= r + radius], home[(dh > r) & (dh <= r + radius)])))
        yield from go(outside, home[dh > r], guest[dg > r - radius])

    everyone = np.arange(len(fps))
    yield from go(tree, everyone[:0], everyone) if visit_all else go(tree, everyone, everyone[:0])


class Forest:
    """Union-find over indices, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while (up := p[r]) is not r and not np.array_equal(up, r):
            r = up
        p[x] = r
        return r

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            hi, lo = np.maximum(ra[differ], rb[differ]), np.minimum(ra[differ], rb[differ])
            np.minimum.at(self.parent, hi, lo)


def link(fps: np.ndarray, homes: int, radius: int) -> np.ndarray:
    """Root index of each fingerprint; the first ones are homes, the others visitors, which link with homes only."""
    forest = Forest(len(fps))

    def compare(home: np.ndarray, guest: np.ndarray) -> None:
        other = np.concatenate((home, guest))
        step = max(1, BLOCK // max(1, len(other)))
        for at in range(0, len(home), step):
            part = home[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[other][None, :]) <= radius)
            a, b = part[i], other[j]
            forest.union(a[a != b], b[a != b])

    def go(home: np.ndarray, guest: np.ndarray) -> None:
        if len(home) <= LEAF:
            if len(home):
                compare(home, guest)
            return
        tries = home[np.linspace(0, len(home) - 1, 3).astype(int)]
        far = [np.bitwise_count(fps[home] ^ fps[t]) for t in tries]
        k = int(np.argmax([np.var(d) for d in far]))
        dh = far[k].astype(np.int16)
        dg = np.bitwise_count(fps[guest] ^ fps[tries[k]]).astype(np.int16)
        r = int(np.median(dh))
        r -= not (dh > r).any()
        if not (dh <= r).any() or not (dh > r).any() or int(dh.max()) - int(dh.min()) <= 2:
            compare(home, guest)
            return
        go(home[dh <= r], np.concatenate((guest[dg <= r + radius], home[(dh > r) & (dh <= r + radius)])))
        go(home[dh > r], guest[dg > r - radius])

    go(np.arange(homes), np.arange(homes, len(fps)))
    return forest.roots(np.arange(len(fps)))


def linked(groups: DataFrame, *, radius: int = 4) -> DataFrame:
    """Edges (a, b) of a forest that spans the links among groups(fp, id), one row for each fingerprint."""
    spark = groups.sparkSession
    n = groups.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    sample = groups.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = fit_tree(sample, depth)
    out = to_arrow(spark, "shard int, guest boolean, fp bigint, id bigint")

    def route(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            for shard, home, guest in deal(tree, fps, radius):
                at = np.concatenate((home, guest))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(np.arange(len(at)) >= len(home)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], schema=out)

    def join(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("guest").to_numpy().astype(np.int8), kind="stable")
        fps = rows.column("fp").to_numpy()[order].view(np.uint64)
        ids = rows.column("id").to_numpy()[order]
        roots = link(fps, int((~rows.column("guest").to_numpy()).sum()), radius)
        own = np.arange(len(roots)) != roots
        return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[roots[own]], pa.int64())})

    dealt = groups.select("fp", "id").mapInArrow(route, "shard int, guest boolean, fp bigint, id bigint")
    return dealt.groupBy("shard").applyInArrow(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Documents link if their fingerprints differ in at most radius bits, those of empty and null texts (zero) included.
    Rows with a null id keep a row; they can't be a component's smallest id, and their component is null if no other
    row shares it. Rows of the same id are one document, and all their texts are in its component. Ids must be whole numbers.
    """
    fps = settle(fingerprints(docs, id_col=id_col, text_col=text_col, width=width).select(F.col("id").cast("long").alias("id"), "fp"))
    groups = settle(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    several = settle(fps.filter("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("id"))
    same = fps.join(several, "id", "left_semi").join(groups.withColumnRenamed("id", "gid"), "fp").select(F.col("id").alias("a"), F.col("gid").alias("b"))
    parts = components(linked(groups, radius=radius).union(same), "a", "b")
    named = settle(groups.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), hexed, "component_id")


# --- documents of a wanted similarity ---------------------------------------------------------------------------------

#: Bits by which candidates may differ: of 64, of the first 128 and of all. Sets of a Jaccard similarity of 0.8 differ in a
#: share of 0.1875 at most (4 shingles of 5; of many shingles 0.152), so these lie six deviations above; unlike ones in a half.
DEAL_RADIUS, FIRST_RADIUS, LONG_RADIUS = 31, 51, 267
#: The similarity that those bounds are made for.
LEAST_SIMILARITY = 0.8
#: Shingles whose sets are compared in one task, and how many each text counts for besides its own.
CHUNK, TEXT_COST = 1 << 20, 256
#: Bytes in a broadcast of a name's hash, of a name itself, and of all of them at most.
SENT_BYTES, NAME_BYTES, MOST_SENT = 24, 80, 64 << 20
#: Fingerprints of one side of a task (130 bytes each).
SIDE = 65_536


def link_similar(words: np.ndarray, sizes: np.ndarray, homes: int, similarity: float, own: bool) -> np.ndarray:
    """Root index of each row of words (long fingerprints), candidates united; the first ones are homes, the others visitors.

    Sizes bound the similarity; two words of the fingerprint, then all of it, find candidates. own: homes meet each other too."""
    forest = Forest(len(words))
    order = np.argsort(sizes, kind="stable")
    if not own:
        order = order[order >= homes]
    sorted_sizes = sizes[order]
    mine = np.argsort(sizes[:homes], kind="stable")
    first = np.ascontiguousarray(words[:, :2].T)
    at = 0
    while at < len(mine):
        low = sizes[mine[at]] * similarity
        step = 256
        block = mine[at : at + step]
        other = order[np.searchsorted(sorted_sizes, low - 1e-6, "left") : np.searchsorted(sorted_sizes, sizes[block[-1]] / similarity + 1e-6, "right")]
        for k in range(0, len(other), max(1, BLOCK // len(block))):
            some = other[k : k + max(1, BLOCK // len(block))]
            far = np.bitwise_count(first[0][block][:, None] ^ first[0][some][None, :])
            far += np.bitwise_count(first[1][block][:, None] ^ first[1][some][None, :])
            i, j = np.nonzero(far <= FIRST_RADIUS)
            a, b = block[i], some[j]
            fit = (a != b) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-6)
            a, b = a[fit], b[fit]
            for at_pair in range(0, len(a), BLOCK // LONG_WORDS):
                x, y = a[at_pair : at_pair + BLOCK // LONG_WORDS], b[at_pair : at_pair + BLOCK // LONG_WORDS]
                near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= LONG_RADIUS
                forest.union(x[near], y[near])
        at += step
    return forest.roots(np.arange(len(words)))


def link_exact(sets: list[np.ndarray], homes: int, similarity: float) -> np.ndarray:
    """Root index of each set of hashes, those of the Jaccard similarity or more united; the first ones are homes, the others visitors.

    Pairs that are united already aren't compared."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, has = np.split(codes.astype(np.int32), np.cumsum(sizes)[:-1]), np.zeros(len(values), np.uint8)
    for i in range(homes):
        later = np.arange(i + 1, len(sets))
        fit = np.minimum(sizes[later], sizes[i]) >= similarity * np.maximum(sizes[later], sizes[i]) - 1e-6
        roots = forest.roots(np.arange(len(sets)))
        later = later[fit & (roots[later] != roots[i])]
        if not len(later):
            continue
        has[codes[i]] = 1
        both = np.add.reduceat(has[np.concatenate([codes[j] for j in later])], np.concatenate(([0], np.cumsum(sizes[later])[:-1])), dtype=np.int64)
        has[codes[i]] = 0
        near = later[both >= similarity * (sizes[i] + sizes[later] - both) - 1e-6]
        forest.union(np.full(len(near), i), near)
    return forest.roots(np.arange(len(sets)))


def text_mark(text: F.Column) -> F.Column:
    """A digest that tells texts of an id apart; null is as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def confirmed(rows: DataFrame, candidates: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) of forests that span the links of exact similarity among the texts of rows(id, text) named by candidates(node, id, mark, component).

    A component's texts are dealt to chunks of about as many shingles, and every two chunks meet in a task."""
    spark = rows.sparkSession

    def make():
        def work(cols: dict[str, list]) -> dict[str, list]:
            found = [shingle_set(t, width) for t in cols["text"]]
            return {"component": cols["component"], "id": cols["node"], "n": [len(x) for x in found], "hashes": [x.tobytes() for x in found]}

        return work

    named = rows.withColumn("mark", text_mark(F.col("text")))
    # Candidates are few; their names' hashes are sent to the scan, if they fit, so that only their texts travel.
    name = F.xxhash64("id", "mark")
    if candidates.count() * SENT_BYTES <= MOST_SENT:
        named = named.join(F.broadcast(candidates.select(name.alias("name")).distinct()), name == F.col("name"), "left_semi")
    named = named.join(candidates, ["id", "mark"]).select("component", "node", "text")
    sets = settle(arrow_map(named, make, "component bigint, id bigint, n bigint, hashes binary").filter("n > 0"))
    chunks = settle(sets.groupBy("component").agg(F.ceil(F.sum(F.col("n") + TEXT_COST) / CHUNK).cast("int").alias("chunks")))
    sets = sets.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("last", F.col("chunks") - 1)
    home = sets.select("component", F.col("chunk").alias("i"), F.explode(F.sequence("chunk", "last")).alias("j"), F.lit(False).alias("guest"), "id", "hashes")
    guest = sets.filter("chunk > 0").select("component", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("i"), F.col("chunk").alias("j"), F.lit(True).alias("guest"), "id", "hashes")

    def compare(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(np.asarray(part.column("guest").to_numpy(), np.int8), kind="stable")))
        # Homes meet each other as well in every pair of chunks; that costs no more than the pair itself.
        ids, homes = part.column("id").to_numpy(), int((~np.asarray(part.column("guest").to_numpy(), bool)).sum())
        roots = link_exact([np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()], homes, similarity)
        own = np.arange(len(roots)) != roots
        return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[roots[own]], pa.int64())})

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return home.union(guest).groupBy("component", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id, mark (a digest of its text), component_id (smallest id reachable) and kept, over texts of the similarity or more.

    Similarity is the Jaccard similarity of the texts' sets of shingles, each counted once. Fingerprints of 1024 bits find
    candidates by bounds that similar texts keep but for about one pair in 10^8; of every link the sets themselves decide.
    Texts are dealt by number of shingles, in bands as wide as the similarity allows sizes to differ, and visit the band
    below; bands with more than a shard's worth are divided by the vantage-point tree, and what meets in a leaf is cut into
    sides of bounded size, every two of which meet in a task. Null and empty texts are one group. Texts are linked, not
    ids: an id with several texts may be in several components. kept holds for the least (id, mark) of a component, and as
    often as that row is repeated. Null ids keep a row of null component, unless a row with an id has the same shingles, and of null kept.
    """
    if similarity < LEAST_SIMILARITY:
        raise ValueError(f"similarity must be {LEAST_SIMILARITY} or more")
    spark = docs.sparkSession

    def make():
        def work(cols: dict[str, list]) -> dict[str, list]:
            found = [long_fingerprint(t, width) for t in cols["text"]]
            return {"id": cols["id"], "mark": cols["mark"], "n": [x[0] for x in found], "key": [x[1] for x in found], "fp": [x[2] for x in found]}

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fps = settle(arrow_map(rows.withColumn("mark", text_mark(F.col("text"))), make, "id bigint, mark binary, n bigint, key binary, fp binary"))
    groups = fps.filter("id is not null").groupBy("key", "fp", "n").agg(F.min(F.struct("id", "mark")).alias("least"))
    groups = settle(groups.select("key", "fp", "n", "least.*", F.monotonically_increasing_id().alias("node")))
    wide = float(-np.log(similarity))
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / wide).cast("int")
    most = groups.groupBy(band.alias("band")).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(1, most / SHARD)))))
    head = groups.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE if depth else 0).toPandas()["fp"]
    tree = fit_tree(np.array([int.from_bytes(x[:8], "little") for x in head], np.uint64), depth)
    schema = "band int, leaf int, guest boolean, node bigint, n bigint, fp binary"
    out = to_arrow(spark, schema)

    def route(batches):
        for batch in batches:
            first = np.array([int.from_bytes(x.as_buffer().to_pybytes()[:8], "little") for x in batch.column("fp")], np.uint64)
            for below, visit_all in ((0, False), (1, True)):
                for leaf, home, guest in deal(tree, first, DEAL_RADIUS, visit_all=visit_all):
                    at = np.concatenate((home, guest))
                    if len(at):
                        bands = batch.column("band").to_numpy()[at] - below
                        yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int32()), pa.array(np.full(len(at), leaf, np.int32)), pa.array(np.arange(len(at)) >= len(home)), *[batch.column(c).take(pa.array(at)) for c in ("node", "n", "fp")]], schema=out)

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(np.asarray(rows.column("guest").to_numpy(), np.int8), kind="stable")))
        words = np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(-1, LONG_WORDS)
        nodes = rows.column("node").to_numpy()
        own = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        roots = link_similar(words, rows.column("n").to_numpy().astype(float), int((~np.asarray(rows.column("guest").to_numpy(), bool)).sum()), similarity, own)
        some = np.arange(len(roots)) != roots
        return pa.table({"a": pa.array(nodes[some], pa.int64()), "b": pa.array(nodes[roots[some]], pa.int64())})

    dealt = groups.select(band.alias("band"), "node", "n", "fp").mapInArrow(route, schema)
    sides = lambda guest: F.ceil(F.count_if(F.col("guest") == guest) / SIDE).cast("int")
    counts = settle(dealt.groupBy("band", "leaf").agg(sides(False).alias("homes"), sides(True).alias("guests")).filter("homes > 0"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.greatest("guests", F.lit(1))).otherwise(F.greatest("homes", F.lit(1)))).cast("int")
    rows_of = dealt.join(F.broadcast(counts), ["band", "leaf"]).withColumn("mine", mine)
    # Side i of the homes meets itself, the sides after it, and every side of the guests, which are numbered after the homes'.
    task = lambda i, j, guest: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(guest).alias("visits"))
    span = lambda a, b: F.filter(F.sequence(F.lit(0), F.col("homes") + F.col("guests")), lambda k: (k >= a) & (k < b))
    as_home = F.transform(span(F.col("mine"), F.col("homes") + F.col("guests")), lambda j: task(F.col("mine"), j, False))
    as_other = F.transform(span(F.lit(0), F.col("mine")), lambda i: task(i, F.col("mine"), True))
    as_guest = F.transform(span(F.lit(0), F.col("homes")), lambda i: task(i, F.col("homes") + F.col("mine"), True))
    tasks = rows_of.select("band", "leaf", "node", "n", "fp", F.inline(F.when(F.col("guest"), as_guest).otherwise(F.concat(as_home, as_other)))).withColumnRenamed("visits", "guest")
    candidates = components(tasks.groupBy("band", "leaf", "i", "j").applyInArrow(join, "a bigint, b bigint"), "a", "b")
    candidates = settle(candidates.withColumnRenamed("id", "node").join(groups.select("node", "id", "mark"), "node"))
    # A row that is repeated stands for itself once.
    again = settle(fps.filter("id is not null").groupBy("id", "mark").agg(F.count("*").alias("k")).filter("k > 1").select("id", "mark"))
    texts = rows
    if not again.isEmpty():
        marked = rows.withColumn("mark", text_mark(F.col("text")))
        once = marked.join(again, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min("text").alias("text"))
        texts = marked.join(again, ["id", "mark"], "left_anti").select("id", "text").union(once.select("id", "text"))
    parts = components(confirmed(texts, candidates, width, similarity), "a", "b")
    named = settle(groups.join(parts.withColumnRenamed("id", "of"), F.col("node") == F.col("of"), "left").select("key", F.coalesce("component", "node").alias("component"), F.struct("id", "mark").alias("least")))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    named = settle(named.join(first, "component").select("key", "first"))
    found = fps.join(named, "key", "left")
    return found.select(F.col("id").alias(id_col), "mark", F.col("first.id").alias("component_id"), ((F.col("id") == F.col("first.id")) & (F.col("mark") == F.col("first.mark"))).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that similar_documents() keeps, one of each component, with the columns of docs.

    Which rows go is told by id and text, so an id's other texts stay. A kept row that is repeated stays once: of rows that
    differ elsewhere the least one by all columns, which must be of types with an order. Rows with a null id stay.
    """
    found = settle(similar_documents(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity).select(F.col(id_col).cast("long").alias("g_id"), F.col("mark").alias("g_mark"), "kept"))
    same = (F.col(id_col).cast("long") == F.col("g_id")) & (text_mark(F.col(text_col)) == F.col("g_mark"))
    gone = settle(found.filter("not kept").select("g_id", "g_mark").distinct())
    # The names of the rows that go are sent to the scan, if they fit, so that no text travels.
    rest = docs.join(F.broadcast(gone) if gone.count() * NAME_BYTES <= MOST_SENT else gone, same, "left_anti")
    again = settle(found.filter("kept").groupBy("g_id", "g_mark").agg(F.count("*").alias("k")).filter("k > 1").select("g_id", "g_mark"))
    if again.isEmpty():
        return rest
    columns = F.struct(*[F.col(c) for c in docs.columns])
    once = rest.join(again, same, "left_semi").groupBy(F.col(id_col), text_mark(F.col(text_col))).agg(F.min(columns).alias("row")).select("row.*")
    return rest.join(again, same, "left_anti").union(once)
