"""Jaccard join of word n-gram sets: size-aware, light by subsets, heavy by inverted lists, without all pairs.

1. *Prune.* A set's tokens are ordered by hash. Partners share a known number of tokens among a set's smallest ones, so
   tokens of those prefixes are dealt out once, as arrays; a set with too few prefix tokens in other sets has no partner.
   Equal sets are one set from here on.
2. *Order.* The sets left are put in order of rarity. A partner shares 80 % of a set, so sets with fewer shared tokens go.
3. *Hubs.* Sets with an equal min-hash point to the one whose tokens most other sets have, the middle of a group of near
   copies. Each set's nearest hub is verified at once; these few links join most near copies, one link a set and round.
4. *Light.* Small sets enumerate their subsets of each fixed size that a partner must share, and meet by equality. *Heavy*: large sets
   would enumerate too many, and scan the inverted lists of their rarest tokens. The boundary is where the summed cost of
   both is least. Pairs that hubs have joined already are not candidates, nor are pairs that sizes, shared tokens, the place of the
   token or a parity sketch (of the tokens that other sets have) rule out; none of these tests can lose a link. Candidates are verified on the sets.
5. *Components* of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscope.llm.common import documents, saved, slices, texts
from siltscope.llm.components import components
from siltscope.llm.words import U, Words, deal, group_starts, mix

SHINGLE = 5
#: a link needs 100 * intersection >= PERCENT * union
PERCENT = 80
#: documents whose prefixes one group of the pruning pass holds
GROUP_DOCS = 1500
#: up to so many sets' ids (8 bytes each) are broadcast to fetch their texts; beyond it the join shuffles
BROADCAST_SETS = 1_000_000
HASHES = 4
ROUNDS = 3
#: sets of up to so many tokens may enumerate subsets
SMALL = 20
#: longs of a parity sketch
SKETCH = 8
#: rows without a doc_id carry it through the joins; it links and loses like any other id
LAST = np.iinfo(np.int64).max


def needed(n):
    """Tokens that a set of n shares with any partner, at least: ceil(n * PERCENT / 100)."""
    return (n * PERCENT + 99) // 100


def wanted(n):
    """Prefix tokens shared with any partner of n or more, if prefixes are n - needed(n) + wanted(n) long."""
    return 1 + n // 10


def shingle_sets(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: row and token of every distinct (row, token), sorted, and the tokens of each row."""
    w = Words(text, lower=True)
    at, h = w.runs(k)
    doc = w.doc[at]
    counts = w.counts()
    for short in range(1, k):  # a text of fewer words is one token
        rows = np.flatnonzero(counts == short)
        if len(rows):
            at_s, h_s = w.runs(short)
            pick = np.searchsorted(at_s, w.first[rows])
            doc, h = np.concatenate((doc, rows)), np.concatenate((h, h_s[pick]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        g = group_starts(doc, h)
        doc, h = doc[g], h[g]
    return doc, h, np.bincount(doc, minlength=len(text))


def set_keys(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit identity of each row's set."""
    out = np.zeros((2, len(n)), dtype=U)
    if len(h):
        g = group_starts(doc)
        for row, salt in zip(out, (U(0x51ED270B9F1E6A35), U(0xB492B66FBE98F273))):
            row[doc[g]] = np.add.reduceat(mix(h ^ salt), g)
    return out[0].view(np.int64), out[1].view(np.int64)


def members(t: DataFrame, k: int, n_groups: int) -> DataFrame:
    """One row per document: doc_id, key (of its text), n, k1, k2 (its set), alive (the set may have a partner)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for b in slices(batches):
            chunk += 1
            doc, h, n = shingle_sets(b.column("text"), k)
            k1, k2 = set_keys(doc, h, n)
            ids = np.array([LAST if x is None else x for x in b.column("doc_id").to_pylist()], dtype=np.int64)
            # equal sets of the slice are one: the first row stands for them
            _, first, of = np.unique(np.stack((k1, k2), 1), axis=0, return_index=True, return_inverse=True)
            of = of.reshape(-1)
            lead = first[of]
            place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            size = n[doc]
            use = (lead[doc] == doc) & (place < np.minimum(size, size - needed(size) + wanted(size)))
            doc, h = doc[use], h[use]
            order = np.argsort(h, kind="stable")
            doc, h = doc[order], h[order]
            base = np.zeros(len(n), dtype=np.int32)
            if len(h):
                g = group_starts(h)
                times = np.diff(np.append(g, len(h)))
                many = np.repeat(times > 1, times)
                np.add.at(base, doc[many], 1)
                # a token of several sets here is known to be shared: others are told, no answer is needed
                row = np.where(many, -1, doc)[g].astype(np.int32)
                tokens = h[g]
            else:
                row, tokens = np.empty(0, np.int32), h
            out = [(p, chunk, tokens[i].tobytes(), row[i].tobytes(), None, None, None, None, None, None, None) for p, i in deal(tokens, n_groups)]
            out.append((chunk % n_groups, chunk, None, None, ids.tobytes(), n.astype(np.int32).tobytes(), k1.tobytes(), k2.tobytes(), lead.astype(np.int32).tobytes(), base.tobytes(), b.column("key").to_numpy().tobytes()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 9]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], NAMES)

    def shared(table: pa.Table) -> pa.Table:
        posts = table.filter(pc.is_valid(table.column("tokens")))
        rest = table.filter(pc.is_null(table.column("tokens")))
        out = []
        if posts.num_rows:
            tokens = [np.frombuffer(x, np.uint64) for x in posts.column("tokens").to_pylist()]
            rows = [np.frombuffer(x, np.int32) for x in posts.column("rows").to_pylist()]
            chunks = np.repeat(np.array(posts.column("chunk").to_pylist(), np.int64), [len(x) for x in rows])
            tok, row = np.concatenate(tokens), np.concatenate(rows)
            order = np.argsort(tok, kind="stable")
            g = group_starts(tok[order])
            times = np.diff(np.append(g, len(tok)))
            many = np.zeros(len(tok), dtype=bool)
            many[order] = np.repeat(times > 1, times)
            many &= row >= 0
            chunks, row = chunks[many], row[many]
            order = np.lexsort((row, chunks))
            chunks, row = chunks[order], row[order]
            if len(row):
                g = group_starts(chunks, row)
                c, r, times = chunks[g], row[g], np.diff(np.append(g, len(row))).astype(np.int32)
                cut = group_starts(c)
                out = [(int(c[a]), r[a:z].tobytes(), times[a:z].tobytes()) for a, z in zip(cut, np.append(cut[1:], len(c)))]
        answers = pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["chunk", "rows", "times"])
        for name in NAMES[4:]:
            answers = answers.append_column(name, pa.nulls(len(out), pa.binary()))
        rest = pa.table({"chunk": rest.column("chunk"), "rows": rest.column("rows"), "times": pa.nulls(rest.num_rows, pa.binary()), **{c: rest.column(c) for c in NAMES[4:]}})
        return pa.concat_tables([answers, rest])

    def judge(table: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        shown = ["doc_id", "key", "n", "k1", "k2", "alive"]
        own = [r for r in table.to_pylist() if r["ids"] is not None]
        if not own:
            return pa.table([pa.array([], x) for x in kinds], names=shown)
        r = own[0]
        ids, key, n, k1, k2 = (np.frombuffer(r[c], d) for c, d in (("ids", np.int64), ("keys", np.int64), ("n", np.int32), ("k1", np.int64), ("k2", np.int64)))
        lead, count = np.frombuffer(r["lead"], np.int32), np.frombuffer(r["base"], np.int32).copy()
        for rows, times in zip(table.column("rows").to_pylist(), table.column("times").to_pylist()):
            if times is not None:
                count[np.frombuffer(rows, np.int32)] += np.frombuffer(times, np.int32)
        n64 = n.astype(np.int64)
        alive = (count >= wanted(needed(n64))) & (n64 > 0)
        return pa.table([pa.array(x, kind) for x, kind in zip((ids, key, n, k1, k2, alive[lead]), kinds)], names=shown)

    blobs = "ids binary, n binary, k1 binary, k2 binary, lead binary, base binary, keys binary"
    posts = t.mapInArrow(post, f"p int, chunk long, tokens binary, rows binary, {blobs}")
    answers = posts.groupBy("p").applyInArrow(shared, f"chunk long, rows binary, times binary, {blobs}")
    return answers.groupBy("chunk").applyInArrow(judge, "doc_id long, key long, n int, k1 long, k2 long, alive boolean")


NAMES = ["p", "chunk", "tokens", "rows", "ids", "n", "k1", "k2", "lead", "base", "keys"]


def token_sets(t: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(sid, n, tokens) of the sets (sid, doc_id, key, k1, k2), from the text with this key of the document doc_id."""
    few = sets.count() <= BROADCAST_SETS
    wanted_sets = sets.select("sid", "doc_id", "key", "k1", "k2")
    j = t.join(F.broadcast(wanted_sets) if few else wanted_sets, ["doc_id", "key"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, h, n = shingle_sets(b.column("text"), k)
            k1, k2 = set_keys(doc, h, n)
            same = (k1 == b.column("k1").to_numpy()) & (k2 == b.column("k2").to_numpy())
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            out = pa.RecordBatch.from_arrays([b.column("sid"), pa.array(n.astype(np.int32)), tokens], ["sid", "n", "tokens"])
            yield out.filter(pa.array(same))

    return j.select("sid", "text", "k1", "k2").mapInArrow(make, "sid long, n int, tokens array<long>")


def parity(doc: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """rows x SKETCH longs: each token flips one bit, so two sketches differ in at most as many bits as the sets in tokens."""
    size = 64 * SKETCH
    place = (mix(h ^ U(0x2545F4914F6CDD1D)) % U(size)).astype(np.int64)
    odd = np.bincount(doc * size + place, minlength=rows * size).reshape(rows, size) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def fits(n_a: Column, s_a: Column, n_b: Column, s_b: Column) -> Column:
    """Sizes and shared tokens allow a link: no intersection exceeds the fewer shared tokens."""
    most = F.least(s_a, s_b)
    return 100 * most >= PERCENT * (n_a + n_b - most)


def apart(a: str, b: str) -> Column:
    """Tokens in which two sets differ, at least: those that no other set has, and the bits in which the sketches of the others differ."""
    own = F.col(f"{a}.n") - F.col(f"{a}.s") + F.col(f"{b}.n") - F.col(f"{b}.s")
    return sum((F.bit_count(F.get(f"{a}.bits", i).bitwiseXOR(F.get(f"{b}.bits", i))) for i in range(SKETCH)), own)


def near(a: str, b: str) -> Column:
    """``apart`` allows a link: linked sets differ in at most (100 - PERCENT) / (100 + PERCENT) of their summed sizes."""
    return apart(a, b) * (100 + PERCENT) <= (100 - PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def sketched(active: DataFrame) -> DataFrame:
    """``active`` with ``bits``, the parity sketch of its column ``all_shared``, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("all_shared")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(U)
            bits = parity(np.repeat(np.arange(len(n)), n), tokens, len(n))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, SKETCH, dtype=np.int32)), pa.array(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], sketch], [*kept, "bits"])

    kept = [c for c in active.columns if c != "all_shared"]
    schema = T.StructType([*active.select(*kept).schema.fields, T.StructField("bits", T.ArrayType(T.LongType()))])
    return active.select(*kept, "all_shared").mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    x = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    j = pairs.select("a", "b").join(x, "a").join(y, "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return j.filter(100 * both >= PERCENT * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def overlap(n: int, m: int) -> int:
    """Tokens that linked sets of n and m share, at least."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def subset_sizes(n: int) -> list[int]:
    """The sizes of subsets that a set of n enumerates: what it must share with each size of partner that it can have."""
    return sorted({overlap(n, m) for m in range(max(1, needed(n)), n * 100 // PERCENT + 1)} - {0})


def subsets(shared: int, n: int) -> float:
    from math import comb

    return float(sum(comb(shared, c) for c in subset_sizes(n) if c <= shared))


def boundary(active: DataFrame) -> int:
    """The size up to which sets enumerate subsets, at most SMALL: there the summed cost of subsets and lists is least."""
    lists = F.aggregate("one_df", F.lit(0.0), lambda a, x: a + x)
    small = active.filter(F.col("n") <= SMALL)
    rows = small.groupBy("n", "s").agg(F.count("*").alias("sets"), F.sum(lists).alias("lists")).collect()  # at most SMALL * SMALL rows
    cost = {b: sum(subsets(r["s"], r["n"]) * r["sets"] for r in rows if r["n"] <= b) + sum(r["lists"] for r in rows if r["n"] >= needed(b + 1)) for b in range(SMALL + 1)}
    return min(cost, key=lambda b: (cost[b], -b))


def salted(j: int):
    # a function of one argument: a second one would be the place in the array
    return lambda x: F.xxhash64(x["token"], F.lit(j))


def rarest(sets: DataFrame) -> DataFrame:
    """Sets that share enough tokens for a partner: sid, n, s (shared tokens), bits, rank, one (rarest tokens), one_df, mins, small (tokens).

    ``rank`` is least for sets whose tokens most other sets have: the middle of a group of near copies.
    """
    tok = sets.select("sid", "n", F.explode("tokens").alias("token"))
    df = tok.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    by_set = tok.join(df, "token").groupBy("sid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    need = F.floor((F.col("n") * PERCENT + 99) / 100).cast("int")
    a = by_set.withColumn("s", F.size("shared")).filter(F.col("s") >= need)
    room = F.col("n") - need - (F.col("n") - F.col("s")) + 1  # of the n - need + 1 rarest, those that no other set has come first
    mins = [F.array_min(F.transform("shared", salted(j))) for j in range(HASHES * ROUNDS)]
    weight = F.aggregate("shared", F.lit(0.0), lambda x, y: x + F.log2(y["df"].cast("double")))
    a = a.select(
        "sid", "n", "s", (-weight / F.col("n")).alias("rank"),
        F.transform("shared", lambda x: x["token"]).alias("all_shared"),
        F.transform(F.slice("shared", F.lit(1), room), lambda x: x["token"]).alias("one"),
        F.transform(F.slice("shared", F.lit(1), room), lambda x: x["df"]).alias("one_df"),
        F.array(*mins).alias("mins"),
        F.when(F.col("n") <= SMALL, F.sort_array(F.transform("shared", lambda x: x["token"]))).alias("small"),
    )
    return sketched(a)


def hub_links(active: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Verified links (a: hub, b): at most one for each set, to the nearest hub of its min-hashes of this turn that is not ``joined`` with it."""
    m = active.select("sid", "n", "s", "bits", "joined", "rank", F.posexplode(F.slice("mins", turn * HASHES + 1, HASHES)).alias("j", "h"))
    of = F.struct("rank", "sid", "n", "s", "joined", "bits")
    hub = m.groupBy("j", "h").agg(F.min(of).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("j", "h", "hub.*")
    x, y = m.alias("x"), hub.alias("y")
    met = x.join(y, (F.col("x.j") == F.col("y.j")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.joined") != F.col("y.joined")))
    met = met.filter(fits(F.col("x.n"), F.col("x.s"), F.col("y.n"), F.col("y.s")) & near("x", "y"))
    best = met.groupBy(F.col("x.sid").alias("b")).agg(F.min(F.struct(apart("x", "y").alias("apart"), F.col("y.sid").alias("sid"))).alias("hub"))
    return verified(best.select(F.col("hub.sid").alias("a"), "b"), sets)


def subset_keys(active: DataFrame, limit: int) -> DataFrame:
    """(sid, key): the hash of every subset, of each size that can be needed, of the shared tokens of sets up to ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        for b in batches:
            sid, key = [], []
            for s, n, tokens in zip(*(b.column(c).to_pylist() for c in ("sid", "n", "small"))):
                h = [int(x) for x in mix(np.array(tokens, dtype=np.int64).view(U))]
                for c in subset_sizes(n):
                    for picked in combinations(h, c):
                        key.append((sum(picked) * 0x9E3779B97F4A7C15 + c) & 0x7FFFFFFFFFFFFFFF)
                        sid.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(key, pa.int64())], ["sid", "key"])

    return active.filter(F.col("n") <= limit).select("sid", "n", "small").mapInArrow(run, "sid long, key long")


def light_heavy(active: DataFrame, limit: int) -> DataFrame:
    """Candidate pairs (a < b) of different ``joined`` groups."""
    facts = active.select("sid", "n", "s", "joined", "bits")
    light = subset_keys(active, limit).join(facts, "sid").select("sid", "n", "s", "joined", "bits", F.lit(0).alias("heavy"), "key", F.lit(0).alias("at"))
    lists = F.posexplode("one").alias("i", "key")
    heavy = active.filter(F.col("n") >= needed(limit + 1)).select("sid", "n", "s", "joined", "bits", F.lit(1).alias("heavy"), lists)
    heavy = heavy.select("sid", "n", "s", "joined", "bits", "heavy", "key", (F.col("n") - F.col("s") + F.col("i")).alias("at"))
    posts = light.unionByName(heavy)
    mixed = posts.groupBy("heavy", "key").agg(F.min("joined").alias("lo"), F.max("joined").alias("hi")).filter("lo <> hi").select("heavy", "key")
    posts = posts.join(mixed, ["heavy", "key"])
    # of the first token that two sets share, neither has a common one before it
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    pairs = posts.alias("a").join(posts.alias("b"), ["heavy", "key"]).filter(
        (F.col("a.sid") < F.col("b.sid")) & (F.col("a.joined") != F.col("b.joined"))
        & fits(F.col("a.n"), F.col("a.s"), F.col("b.n"), F.col("b.s"))
        & (left * (100 + PERCENT) >= PERCENT * (F.col("a.n") + F.col("b.n")))
        & ((F.col("heavy") == 0) | (F.greatest("a.n", "b.n") > limit)) & near("a", "b")
    )
    return pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()


def with_joined(active: DataFrame, found: DataFrame) -> DataFrame:
    """``active`` with the component that the links found so far give each set."""
    c = components(found).select(F.col("id").alias("c_id"), "component")
    return active.join(c, active.sid == c.c_id, "left").withColumn("joined", F.coalesce("component", "sid")).drop("c_id", "component")


def linked(active: DataFrame, sets: DataFrame, limit: int | None = None) -> DataFrame:
    """(sid, component) of the active sets: hub links first, then the links between what they have not joined."""
    found = saved(hub_links(active.withColumn("joined", F.col("sid")), sets, 0), "hub-links")
    for turn in range(1, ROUNDS):
        found = saved(found.unionByName(hub_links(with_joined(active, found), sets, turn)), "hub-links")
    joined = saved(with_joined(active, found), "joined")
    limit = boundary(active) if limit is None else min(limit, SMALL)
    links = verified(light_heavy(joined, limit), sets)
    # a component needs one link between two groups, however many there are
    of = joined.select("sid", "joined")
    a, b = of.select(F.col("sid").alias("a"), F.col("joined").alias("ja")), of.select(F.col("sid").alias("b"), F.col("joined").alias("jb"))
    groups = links.join(a, "a").join(b, "b").select(F.col("ja").alias("a"), F.col("jb").alias("b")).distinct()
    c = components(groups).select(F.col("id").alias("joined"), "component")
    return of.join(c, "joined", "left").select("sid", F.coalesce("component", "joined").alias("component"))


def jaccard_join(docs: DataFrame, k: int = SHINGLE, limit: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_key (the text's xxhash64, which tells rows of one doc_id apart).

    ``component_id`` is the smallest doc_id that links reach; ``limit`` sets the boundary between light and heavy. Null, empty
    and blank texts have no set and link with nothing. Rows without a doc_id link like others but name a group only
    if all its rows lack one. Repeated rows are equal sets. An empty table gives an empty result.
    """
    t = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("key", F.xxhash64("text"))
    m = saved(members(t, k, max(64, t.count() // GROUP_DOCS)), "members")
    # a set has a name of its own: rows without a doc_id, and texts under one doc_id, are sets apart
    equal = m.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "key")).alias("x"), F.count("*").alias("rows"), F.max("alive").alias("alive"))
    equal = saved(equal.select(F.monotonically_increasing_id().alias("sid"), "x.doc_id", "x.key", "k1", "k2", "rows", "alive"), "sets")
    alive = equal.filter("alive").select("sid", "doc_id", "key", "k1", "k2")
    sets = saved(token_sets(t, alive, k), "tokens")
    if sets.count() != alive.count():  # a repeated row gave its set twice
        sets = saved(sets.dropDuplicates(["sid"]), "tokens")
    active = saved(rarest(sets), "active")
    found = linked(active, sets, limit).withColumnRenamed("sid", "id")
    of = equal.join(found, equal.sid == found.id, "left").select("k1", "k2", F.coalesce("component", "sid").alias("c"), "rows", "doc_id")
    names = of.groupBy("c").agg(F.min("doc_id").alias("component"), F.sum("rows").alias("all")).filter(F.col("all") > 1)
    named = of.join(names, "c").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "component")
    r = m.join(named, (m.k1 == named.s1) & (m.k2 == named.s2) & (m.n > 0), "left")
    shown = lambda c: F.when(c != LAST, c)
    return r.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), shown(F.coalesce("component", "doc_id")).alias("component_id"), F.col("key").alias("text_key"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
