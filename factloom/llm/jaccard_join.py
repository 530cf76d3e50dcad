"""N-gram Jaccard self-join with token-combination prefixes.

A document is its set of word shingles (tokens, 64-bit hashes).  Two documents
link at a Jaccard similarity of 75 % or more.  The join is exact on these sets:

1. Frequencies.  Texts go into blocks; each block sends its distinct tokens, cut
   into hash ranges, and a count of documents for each; a range sums them and
   sends each block one byte for each of its tokens, so a token of a third of
   all documents costs one entry for each block.
2. Prefixes.  A set of n tokens misses at most t = n - ceil(0.75 n) tokens of a
   set it links with.  In the global order (rare first, by frequency class and
   hash) the first tokens are taken until they *cover* t + 1: a rare token covers
   one and is indexed by itself.  A frequent token is indexed in combinations of k
   = 2, a very frequent one in those of k = 3: they are dealt over subclasses by
   hash, and a subclass with j tokens in the prefix covers j - k + 1, for which all
   its combinations of k are indexed.  Losing t tokens uncovers at most t, so
   linked sets share an entry.  The number of subclasses goes by the power of two
   below n; a set that can link with smaller ones of the next lower power also
   indexes by that one's.  A set whose t + 1 rarest tokens occur nowhere else links
   with nothing and is done.
3. Verification.  Equal sets are one class, with the smallest doc_id for all.
   Of the sets that share an index entry, each is first compared with one of them
   (its hub), which is linear in the entries; linked sets become one component,
   and entries that lie within one component are done.  Rounds with other hubs
   follow as long as each takes a tenth off the pairs that are left.  Then entries
   across components are compared pair by pair, each pair at one entry: of entries
   with the same sets one stays, every set carries its first few entries, and where
   two sets share some of these, only the least of them counts for the pair.  Sets
   that their tokens of their own keep from linking with any other of an entry have
   left its list before.  The join itself drops pairs that can't link,
   by their sizes, by their tokens that no other set has, and by a sketch of the
   others (a bit for each of 512 hash buckets, the parity of the bucket's tokens, so
   two sketches differ in at most as many bits as the sets do in tokens): linked
   sets differ in at most a seventh of their tokens.  A hub with many partners is
   dealt over several places.

Null and empty texts have no tokens and link with nothing.  Rows that share a
doc_id are one node: their sets link them together.  A row without doc_id takes
part by its text and is returned without one; its component_id is the smallest
doc_id that it reaches, or null.  Such sets take identifiers from 2**62 on; where a
doc_id is as large, all go by their places in order instead.  The time of a very long text follows its length; its set is held by one
task.  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import dealt_join, dropped, new_path, without, written
from .shingles import PLACES, Shingler, mixed, set_key, similar
from .workers import bounded_batches, give_back, lean

BLOCK_BYTES = 8_000_000
FREQUENT = {2: 24, 3: 576}  # sets with a token from which on it is indexed in combinations of so many
PARTNERS_AT_A_PLACE = 256
FIRST_ENTRIES = 8  # what a set carries to tell where a pair counts
RESERVED = 1 << 62  # identifiers of sets without a doc_id of their own


def frequency_class(n: np.ndarray) -> np.ndarray:
    """One byte: exact up to 100, then eight steps for each doubling."""
    return np.where(n <= 100, n, np.minimum(255, 100 + 8 * np.log2(np.maximum(n, 100) / 100))).astype(np.uint8)


FREQUENT_CLASS = {k: int(frequency_class(np.array([n]))[0]) for k, n in FREQUENT.items()}


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


BLOCK_SCHEMA = "kind string, block string, doc_ids array<bigint>, lengths array<int>, texts binary, part int, tokens binary, counts binary"
_BLOCK = pa.schema([
    ("kind", pa.string()), ("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("texts", pa.binary()), ("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()),
])


def _counted_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a block, and how many different sets hold each."""
    unlike = list({set_key(s): s for s in sets if len(s)}.values())
    if not unlike:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(unlike), return_counts=True)


def _cuts(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the hash space begins and the last ends."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


def _packed_tokens(tokens: np.ndarray) -> bytes:
    """Sorted numbers as gaps; 40 bits are enough to tell frequencies."""
    gaps = np.diff(tokens >> np.uint64(24), prepend=np.uint64(0))
    return _pack(np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:5]).tobytes())


def _unpacked_tokens(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(5, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :5] = planes.T
    return np.cumsum(gaps.view("<u8").ravel())


def _blocks(parts: int, width: int):
    def run(tables):
        shingler = Shingler(width)

        def closed(docs):
            name = uuid.uuid4().hex
            tokens, counts = _counted_sets([s for _, _, s in docs])
            raw = [t.encode("utf-8", "replace") for _, t, _ in docs]
            rows = [{"kind": "texts", "block": name, "doc_ids": [d for d, _, _ in docs], "lengths": [len(r) for r in raw], "texts": _pack(b"".join(raw))}]
            cuts = _cuts(tokens, parts)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                rows.append({"kind": "tokens", "block": name, "part": k, "tokens": _packed_tokens(tokens[a:b]), "counts": _pack(np.minimum(counts[a:b], 65535).astype("<u2").tobytes())})
            return pa.RecordBatch.from_pylist(rows, _BLOCK)

        docs, size = [], 0
        for t in tables:
            for doc_id, text in zip(t.column(0), t.column(1)):
                text = text.as_py() or ""
                docs.append((doc_id.as_py(), text, shingler.set_of(text)))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield closed(docs)
                    docs, size = [], 0
        if docs:
            yield closed(docs)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """One range: the frequency class of each block's tokens, in their order."""
    blocks = table.column("block").to_pylist()
    tokens = [_unpacked_tokens(x.as_py()) for x in table.column("tokens")]
    counts = [np.frombuffer(_unpack(x.as_py()), "<u2") for x in table.column("counts")]
    every, of = np.unique(np.concatenate(tokens), return_inverse=True)
    classes = frequency_class(np.bincount(of, np.concatenate(counts), len(every)))[of]
    ends = np.cumsum([len(t) for t in tokens])
    packed = [_pack(c.tobytes()) for c in np.split(classes, ends[:-1])]
    del tokens, counts, every, of, classes
    give_back()
    return pa.table({"block": blocks, "part": table.column("part"), "classes": pa.array(packed, pa.binary())})


def _combinations(tokens: np.ndarray, group: np.ndarray, k: int) -> list[np.ndarray]:
    """All k-combinations of the tokens within each group, each as its sorted members' columns."""
    by = np.lexsort((tokens, group))
    t, g = tokens[by], group[by]
    rows = [np.arange(len(t))]
    for _ in range(k - 1):
        last = rows[-1]
        end = np.searchsorted(g, g[last], "right")
        more = end - last - 1  # members of the group after the last one
        at = np.repeat(np.arange(len(last)), more)
        new = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + last[at] + 1
        rows = [r[at] for r in rows] + [new]
    return [t[r] for r in rows]


def prefix_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray | None:
    """Index entries of a set, or None if it can't link with any other one."""
    n = len(tokens)
    need = n // 4 + 1
    if not n or int((classes <= 1).sum()) >= need:
        return None
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    power = n.bit_length() - 1
    schemes = [power] + [power - 1] * (3 * n < 4 << power and power > 0)
    keys = []
    for s in schemes:
        # combinations that leave enough to cover: none of single tokens, pairs in sets of under 8
        k_of = np.ones(n, np.int64)
        for k in (2, 3):
            if s >= 2 * k - 3:
                k_of[classes >= FREQUENT_CLASS[k]] = k
        sub = (tokens >> np.uint64(7)) % np.uint64(1 << max(0, s - 3)) * np.uint64(4) + k_of.astype(np.uint64)
        covers = np.ones(n, np.int64)
        for k in (2, 3):
            at = np.flatnonzero(k_of == k)
            if len(at):
                by = at[np.argsort(sub[at], kind="stable")]  # each subclass in the global order
                starts = np.concatenate([[0], np.flatnonzero(np.diff(sub[by])) + 1])
                place = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
                covers[by[place < k - 1]] = 0
        end = int(np.searchsorted(np.cumsum(covers), need)) + 1
        t, g, k_of = tokens[:end], sub[:end], k_of[:end]
        keys.append(t[(k_of == 1) & (classes[:end] > 1)])
        for k in (2, 3):
            some = k_of == k
            if some.any():
                key = np.uint64(s)
                for place, column in enumerate(_combinations(t[some], g[some], k)):
                    key = mixed(key + column * PLACES[place])
                keys.append(key)
    return np.unique(np.concatenate(keys))


SET_SCHEMA = "doc_id bigint, n_shingles bigint, key binary, tokens binary, alone bigint, sketch array<bigint>, entries array<bigint>"
SKETCH_WORDS = 8


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens in 64 * SKETCH_WORDS buckets."""
    odd = np.bincount((tokens >> np.uint64(17)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(a, b):
    """False only for sets under 75 %: their difference is over a seventh of their sizes' sum.

    a and b: functions from a column's name to the column of one set and of the other.
    """
    near = (a("n_shingles") * 4 >= b("n_shingles") * 3) & (b("n_shingles") * 4 >= a("n_shingles") * 3)
    bits = [F.bit_count(F.element_at(a("sketch"), i).bitwiseXOR(F.element_at(b("sketch"), i))) for i in range(1, SKETCH_WORDS + 1)]
    return near & ((sum(bits[1:], bits[0]) + a("alone") + b("alone")) * 7 <= a("n_shingles") + b("n_shingles"))


def own_id(key: bytes) -> int:
    """What stands for the doc_id of rows that have none: one of the reserved numbers, by their set."""
    return RESERVED | int.from_bytes(key[:8], "little") >> 2


def _indexed(width: int):
    def run(key, texts, classes):
        shingler = Shingler(width)
        raw, row = _unpack(texts.column("texts")[0].as_py()), texts.column("lengths")[0].as_py()
        ends = np.cumsum(row).tolist()
        sets = [shingler.set_of(raw[a:b].decode()) for a, b in zip([0, *ends], ends)]
        every, _ = _counted_sets(sets)
        parts = sorted(zip(classes.column("part").to_pylist(), classes.column("classes")), key=lambda p: p[0])
        of = np.frombuffer(b"".join(_unpack(c.as_py()) for _, c in parts), np.uint8)
        rows = []
        for doc_id, s in zip(texts.column("doc_ids")[0].as_py(), sets):
            if not len(s):
                rows.append((doc_id, 0, None, None, None, None, None))
                continue
            k, c = set_key(s), of[np.searchsorted(every, s)]
            entries = prefix_keys(s, c)
            row = (own_id(k) if doc_id is None else doc_id, len(s), k)
            rows.append(row + ((None,) * 4 if entries is None else (s.astype("<u8").tobytes(), int((c <= 1).sum()), sketch(s[c > 1]), entries.view(np.int64))))
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_shingles", "key", "tokens", "alone", "sketch", "entries"])

    return run


def indexed_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, key, and tokens and index entries of the sets that may link."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # about two million tokens to a range, so that one fits into a task whatever the corpus
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 12_000_000))
    blocks = new_path(spark, "join-blocks")
    table = written(docs.select("doc_id", "text").mapInArrow(lean(_blocks(parts, width)), BLOCK_SCHEMA), "join-blocks", blocks)
    counts = table.filter("kind = 'tokens'").select("block", "part", "tokens", "counts")
    classes = counts.groupBy("part").applyInArrow(_frequencies, "block string, part int, classes binary").withColumnRenamed("block", "of_block")
    texts = table.filter("kind = 'texts'").select("block", "doc_ids", "lengths", "texts")
    sets = written(texts.groupBy("block").cogroup(classes.groupBy("of_block")).applyInArrow(_indexed(width), SET_SCHEMA), "join-sets")
    dropped(spark, blocks)  # the sets are written, so no lost executor asks for their blocks again
    return sets


def _verified(tables):
    for t in tables:
        a, b = ([np.frombuffer(x.as_py(), "<u8") for x in t.column(c)] for c in ("tokens_a", "tokens_b"))
        keep = pa.array([similar(x, y) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(keep)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  Each a's set goes to as many places as it has partners for."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PARTNERS_AT_A_PLACE))).cast("int").alias("places"))
    hubs = (
        sets.join(counts, F.col("doc_id") == F.col("a"))
        .select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at"), F.col("tokens").alias("tokens_a"))
    )
    dealt = pairs.join(counts.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    partners = dealt.join(sets.select(F.col("doc_id").alias("d"), F.col("tokens").alias("tokens_b")), F.col("b") == F.col("d"))
    both = partners.join(hubs, (F.col("a") == F.col("hub")) & (F.col("place") == F.col("at")))
    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(lean(_verified), "a bigint, b bigint")


def classes_of(sets: DataFrame, shared: bool) -> DataFrame:
    """k, r, node, n_rows: of each distinct set its key, smallest doc_id, node and number of rows.

    The node is r, but where r stands for several sets, each of them has a reserved one.
    """
    classes = sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("r"), F.count(F.lit(1)).alias("n_rows")).withColumnRenamed("key", "k")
    if not shared:
        return classes.withColumn("node", F.col("r"))
    several = classes.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("r").alias("several"))
    reserved = F.lit(RESERVED) + F.xxhash64("k").bitwiseAND(F.lit(RESERVED - 1))
    return classes.join(several, F.col("r") == F.col("several"), "left").withColumn("node", F.when(F.col("several").isNull(), F.col("r")).otherwise(reserved)).drop("several")


def _hubs(here: DataFrame, k: int) -> DataFrame:
    """Entries (f) across components, with a hub each, another one in every round, and the pairs that they stand for."""
    order = F.xxhash64("r", F.lit(k // 2)) if k else F.col("r")
    hub = F.struct(order.alias("o"), "r", "c", "n_shingles")
    spread = here.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), (F.max if k % 2 else F.min)(hub).alias("hub"), F.count(F.lit(1)).cast("double").alias("m")).filter("lo < hi")
    return spread.select(F.col("e").alias("f"), F.col("hub.r").alias("hr"), F.col("hub.c").alias("hc"), F.col("hub.n_shingles").alias("hn"), (F.col("m") * (F.col("m") - 1) / 2).alias("m_pairs"))


def _met_hubs(here: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each set of an entry with the entry's hub, where their components differ and their sizes allow a link."""
    near = (F.col("n_shingles") * 4 >= F.col("hn") * 3) & (F.col("hn") * 4 >= F.col("n_shingles") * 3)
    met = here.join(hubs, F.col("e") == F.col("f")).filter("c != hc").filter(near)
    return met.select(F.least("r", "hr").alias("a"), F.greatest("r", "hr").alias("b")).distinct()


SLICE = 2048  # sets of an entry that one task compares with as many


def _met_pairs(here: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """What may link of the pairs that share an entry across components.

    Of entries with the same sets one stays, so that sets that share thousands of them
    meet once; a long entry's sets are dealt over slices, each compared with each.
    """
    left = here.join(hubs.select("f"), F.col("e") == F.col("f")).select("e", "r", "c")
    members = left.groupBy("e").agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.xxhash64("r", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)])
    lists = members.groupBy("m", "h1", "h2").agg(F.min("e").alias("f")).select("f", F.ceil(F.col("m") / SLICE).cast("int").alias("places"))
    left = left.join(lists, F.col("e") == F.col("f")).drop("f")
    first = left.groupBy(F.col("r").alias("of")).agg(F.slice(F.array_sort(F.collect_list("e")), 1, FIRST_ENTRIES).alias("first"))  # a set has a bounded number of entries
    marks = sets.select(F.col("doc_id").alias("d"), "n_shingles", "alone", "sketch")
    left = left.join(marks, F.col("r") == F.col("d")).join(first, F.col("r") == F.col("of")).drop("d", "of")
    left = left.withColumn("i", F.pmod(F.xxhash64("r"), F.col("places")).cast("int"))
    other = left.withColumn("j", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).drop("places")
    left = left.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("places") - 1))).drop("places")
    other = other.toDF(*[f"{c}_2" for c in other.columns])
    both = F.array_intersect("first", "first_2")
    counts_here = (F.size(both) == 0) | (F.array_min(both) == F.col("e"))
    same = (F.col("e") == F.col("e_2")) & (F.col("i") == F.col("i_2")) & (F.col("j") == F.col("j_2"))
    once = (F.col("i") < F.col("j")) | (F.col("r") < F.col("r_2"))  # a slice with itself holds each pair twice
    met = left.join(other, same & (F.col("c") != F.col("c_2")) & once & may_link(F.col, lambda c: F.col(f"{c}_2")) & counts_here)
    return met.select(F.least("r", "r_2").alias("a"), F.greatest("r", "r_2").alias("b")).distinct()


def linked(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes' nodes that link with another one."""
    spark, paths = sets.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        paths.append(new_path(spark, name))
        return written(df, name, paths[-1])

    reps = sets.filter("entries is not null").join(classes, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("r"))).dropDuplicates(["key"])
    reps = kept(reps.select(F.col("node").alias("doc_id"), "n_shingles", "tokens", "alone", "sketch", "entries"), "join-representatives")
    # tokens of its own leave a set this much short of linking (7 times them, less its size); two that link aren't above 0 together
    short = (F.col("alone") * 7 - F.col("n_shingles")).alias("short")
    entries = reps.select(F.col("doc_id").alias("r"), "n_shingles", short, F.explode("entries").alias("e"))
    repeated = entries.groupBy("e").agg(F.count(F.lit(1)).alias("m"), F.min("short").alias("least")).filter("m > 1").select(F.col("e").alias("f"), "least")
    entries = kept(entries.join(repeated, F.col("e") == F.col("f")).filter("short + least <= 0").select("e", "r", "n_shingles"), "join-entries")
    tokens = reps.select("doc_id", "tokens")
    links = of = done = before = None
    k, by_hubs = 0, True
    while True:
        here = entries if of is None else entries.join(of, F.col("r") == F.col("node"), "left")
        here = here.select("e", "r", "n_shingles", (F.col("r") if of is None else F.coalesce("component", "r")).alias("c"))
        hubs = kept(_hubs(here, k), "join-hubs")
        size = hubs.agg(F.count(F.lit(1)).alias("n"), F.sum("m_pairs").alias("pairs")).first()
        if not size["n"]:
            break
        # a round of hubs costs a pass over the entries, and is worth it while it takes a tenth off the pairs
        by_hubs = by_hubs and (before is None or size["pairs"] <= 0.9 * before)
        before = size["pairs"]
        pairs = kept(_met_hubs(here, hubs) if by_hubs else _met_pairs(here, hubs, reps), "join-met")
        if done is not None:
            pairs = kept(pairs.join(done, ["a", "b"], "left_anti"), "join-pairs")
        if not pairs.isEmpty():
            done = pairs if done is None else done.unionByName(pairs)
            found = kept(verified(pairs, tokens), "join-links")
            links = found if links is None else links.unionByName(found)
            of = written(components(links), "join-components")
        if not by_hubs:
            break
        k += 1
    nothing = entries.select(F.col("r").alias("node"), F.col("r").alias("component")).limit(0)
    of = nothing if of is None else of
    if links is not None:  # nothing that is read from here on asks for these tables
        for path in paths:
            dropped(spark, path)
    return of


def join(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    if docs.filter(F.col("doc_id") >= RESERVED).select("doc_id").limit(1).isEmpty():
        return _joined(docs, width)
    # identifiers that sets without one could be given: all go by their place in order
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    places = written(ids.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("place")), "join-places")
    placed = docs.filter("doc_id is not null").join(places, F.col("doc_id") == F.col("id")).select(F.col("place").alias("doc_id"), "text")
    found = written(_joined(placed.unionByName(docs.filter("doc_id is null")), width), "join-placed")
    back = lambda df, column: df.join(places.toDF(f"{column}_id", f"{column}_place"), F.col(column) == F.col(f"{column}_place"), "left")
    return back(back(found, "doc_id"), "component_id").select(F.col("doc_id_id").alias("doc_id"), "n_shingles", F.col("component_id_id").alias("component_id"))


def _joined(docs: DataFrame, width: int) -> DataFrame:
    sets = indexed_sets(docs, width)
    slim = sets.select("doc_id", "n_shingles", "key")
    ids = written(slim.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("shared_id")), "join-shared")
    shared = not ids.isEmpty()
    # equal sets, whether or not their tokens are rare, are one class
    classes = written(classes_of(sets, shared), "join-classes")
    of = linked(sets, classes)
    if shared:
        # a shared doc_id links the sets of its rows
        rows = slim.join(ids, F.col("doc_id") == F.col("shared_id")).join(classes, F.col("key") == F.col("k"))
        by_id = rows.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
        of = written(components(of.toDF("a", "b").unionByName(by_id)), "join-components")
    named = classes.join(of.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").select("k", "n_rows", F.coalesce("component", "r").alias("c"))
    out = dealt_join(slim, named, "key", "k", "n_rows", F.col("doc_id"))
    if shared:  # and so a row without tokens goes by its doc_id
        by_id = of.select(F.col("node").alias("of_id"), F.col("component").alias("by_id"))
        out = out.join(by_id, F.col("key").isNull() & (F.col("doc_id") == F.col("of_id")), "left").withColumn("c", F.coalesce("c", "by_id"))
    known = lambda c: F.when(c < RESERVED, c)
    return out.select(known(F.col("doc_id")).alias("doc_id"), "n_shingles", known(F.coalesce("c", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with all its columns.

    Rows without doc_id stay where none of their component has one; of equal ones a single row stays.
    """
    rows = join(docs.select("doc_id", "text"))
    return without(docs, rows.select("doc_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")))
