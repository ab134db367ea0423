"""Groups of documents whose word shingles are alike: a size-aware join of sets, heavy and light.

First documents go that can have no partner: of the shingles in a fixed share of the hash space, those that only one set
has are counted, and a set with more of them than a partner may lack is out. The others' shingles are then ordered by the
number of sets that have them, ties by hash. Light sets, below a size chosen by cost, enumerate the two-element subsets of
a prefix so long that linked sets share one. Heavy sets scan inverted lists over shorter prefixes; light sets large enough
to be linked with a heavy one are in those lists too.

What is wanted is the groups, so the lists are not turned into pairs. First every member of a list is held against the
list's first member; then only lists that still span several groups are looked at: their members are dealt to blocks
that lie close together, and each pair of blocks that shares a list is decided exactly, by one matrix product.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields, record_batch, slices
from .components import components
from .marks import holds, marked
from .scratch import forget, free_names, stored
from .words import hashes, mixed, release, run_hashes

SHINGLE, NEEDED, OF = 5, 75, 100
#: Tells rows of one doc_id, or without, apart.
TEXT_HASH = "xxhash64(text)"
#: The share of the hash space in which shingles of all sets are counted, in 1024ths; bits of a counted shingle.
COUNTED, COUNTED_BITS = 360, 40
#: Bits of the filter for rows whose sets are looked at; members of a block; blocks of a list that are held in one row.
FILTER_BITS, MOST_BITS, MARKED, BLOCK, HELD = 1 << 24, 1 << 26, 16, 96, 128


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; with fewer words than a shingle has, that of all its words."""
    words = text.encode().lower().split()
    return np.unique(run_hashes(hashes(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def names_of(sets: np.ndarray) -> tuple[int, int]:
    """Twice 64 bits that stand for a set. It goes by the first, or if several sets have that, by the second."""
    data = blake2b(sets.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def linked(common, a, b):
    return OF * common >= NEEDED * (a + b - common)


def _sets(batch, seen: set[int], shared: frozenset[int]):
    """Of each row that has a set and whose set the task hasn't seen: its node and set. ``shared``: first names of several sets."""
    for part in slices(batch):
        for text in part.column("text").to_pylist():
            s = shingles(text or "")
            if len(s):
                node, other = names_of(s)
                node = other if node in shared else node
                if node not in seen:
                    seen.add(node)
                    yield node, s


def _survey(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, other (the set's two names) of every row."""
    docs = docs.select("doc_id", "text", F.expr(TEXT_HASH).alias("text_hash"))
    schema = StructType(docs.select("doc_id").schema.fields + StructType.fromDDL("text_hash long, n_shingles long, node long, other long").fields)
    types = fields(schema)

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(text or "") for text in part.column("text").to_pylist()]
                names = [names_of(s) if len(s) else (None, None) for s in sets]
                yield record_batch({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_shingles": [len(s) for s in sets], "node": [a for a, _ in names], "other": [b for _, b in names]}, types)

    return docs.mapInArrow(run, schema)


def _rows(pairs, column: str, types, size: int = 200_000):
    """Record batches of (array, node) pairs, each value of the array in a row with its node and the array's full size."""
    held, n = [], 0

    def out():
        values = np.concatenate([x for x, _, _ in held]).view(np.int64)
        nodes = np.repeat(np.array([k for _, k, _ in held], np.int64), [len(x) for x, _, _ in held])
        full = np.repeat(np.array([m for _, _, m in held], np.int64), [len(x) for x, _, _ in held])
        return record_batch({column: pa.array(values), "node": pa.array(nodes), "n": pa.array(full)}, types)

    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n > size:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _lonely(docs: DataFrame, shared: frozenset[int]) -> DataFrame:
    """node and alone: how many of its shingles in the counted share no other set has (at least)."""
    types = fields(StructType.fromDDL("token long, node long"))
    most = np.uint64(COUNTED << 54)

    def run(batches):
        release()
        seen: set[int] = set()
        for batch in batches:
            yield from _rows(((s[: np.searchsorted(s, most)] >> np.uint64(64 - COUNTED_BITS), node, 0) for node, s in _sets(batch, seen, shared)), "token", types)

    owned = docs.mapInArrow(run, "token long, node long").groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return owned.where("node = last").groupBy("node").agg(F.count("*").alias("alone"))


def boundary(by_size: list[tuple[int, float, float]]) -> int:
    """The size from which sets are heavy, by the least cost in rows: those of subsets, those of postings, and as many again
    for the scans of heavy sets, which meet the first member of a list for each posting.

    ``by_size``: a size, and over its sets the sums of subsets and postings. Light sets of three quarters of the boundary
    write postings too (they are what heavy sets of at most 4/3 their size must find).
    """
    if not by_size:
        return 0
    s, subsets, postings = np.array(sorted(by_size), float).T
    light = np.concatenate([[0], np.cumsum(subsets)])
    posted = np.concatenate([np.cumsum(postings[::-1])[::-1], [0]])
    at = np.concatenate([s, [s[-1] + 1]])
    return int(at[(light + posted[np.searchsorted(s, NEEDED * at / OF)] + posted).argmin()])


def _prefixes(sets: DataFrame) -> DataFrame:
    """token, node, n, most, df, nth, need: of each set, in order of df, its shingles that others have as well, as far as the
    ``need`` that linked sets must share one of, and one more. ``most``: the largest size of a set that could be linked with
    it, if that had all of its shingles that others have."""
    types = fields(StructType.fromDDL("token long, node long, n long"))

    def run(batches):
        for batch in batches:
            data = (np.frombuffer(x, np.uint64) for x in batch.column("data").to_pylist())
            yield from _rows(((s, node, len(s)) for node, s in zip(batch.column("node").to_pylist(), data, strict=True)), "token", types)

    owned = sets.mapInArrow(run, "token long, node long, n long")
    shared = owned.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    rows = owned.join(shared, "token").select("*", F.row_number().over(own.orderBy("df", "token")).alias("nth"), F.count("*").over(own).alias("others"))
    rows = rows.withColumn("need", F.expr(f"others - ceil({NEEDED} * n / {OF}) + 1")).where("nth <= need + 1 and need > 0")
    return rows.withColumn("most", F.expr(f"floor(others * {OF + NEEDED} / {NEEDED}) - n")).drop("others")


def _lists(prefixes: DataFrame) -> DataFrame:
    """key, node, n, most, first, first_n, first_most of the lists that have several members."""
    each = prefixes.groupBy("node", "n").agg(F.max("nth").alias("k"), F.max("need").alias("need"))
    by_size = each.groupBy("n").agg(F.sum(F.expr("k * (k - 1) / 2")).alias("subsets"), F.sum("need").alias("postings"))
    heavy_from = boundary([(r.n, float(r.subsets), float(r.postings)) for r in by_size.collect()])
    single = prefixes.where(f"nth <= need and {OF} * n >= {NEEDED} * {heavy_from}").select(F.col("token").alias("key"), "node", "n", "most")
    light = prefixes.where(f"n < {heavy_from}").groupBy("node", "n", "most").agg(F.collect_list("token").alias("ts"))
    pair = "xxhash64(least(a, b), greatest(a, b))"
    subsets = light.select(F.explode(F.expr(f"flatten(transform(ts, (a, i) -> transform(slice(ts, i + 2, size(ts)), b -> {pair})))")).alias("key"), "node", "n", "most")
    rows = single.union(subsets)
    heads = rows.groupBy("key").agg(F.min(F.struct("node", "n", "most")).alias("first"), F.max("node").alias("last")).where("first.node <> last")
    return rows.join(heads, "key").select("key", "node", "n", "most", *[F.col(f"first.{c}").alias(to) for c, to in (("node", "first"), ("n", "first_n"), ("most", "first_most"))])


def _sets_of(docs: DataFrame, wanted: DataFrame, collided: frozenset[int]) -> DataFrame:
    """node and data (its set) for the nodes in ``wanted`` (node, doc_id: one document that has it).

    A filter of MARKED bits a document and at least FILTER_BITS keeps other rows from being worked on; rows that pass it by chance go
    by the join. Where it would have more than MOST_BITS, documents meet ``wanted`` by doc_id in a join before they are worked on.
    """
    size = max(FILTER_BITS, 1 << (MARKED * wanted.count() - 1).bit_length())
    numbers = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    key = F.col("doc_id").cast("long") if numbers else F.xxhash64("doc_id")
    rows, shared = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), "text"), None
    ids = wanted.select(F.coalesce(key, F.lit(0)).alias("doc_id"))
    if size > MOST_BITS:
        rows = rows.join(ids.distinct(), "doc_id", "left_semi")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(marked(ids, size))
    schema = StructType.fromDDL("node long, data binary")
    types = fields(schema)

    def run(batches):
        release()
        seen: set[int] = set()
        for batch in batches:
            if shared:
                batch = batch.filter(pa.array(holds(shared.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            held, most = [], 0
            for row in _sets(batch, seen, collided):
                held.append(row)
                most += len(row[1])
                if most > 500_000:
                    yield record_batch({"node": [n for n, _ in held], "data": [s.tobytes() for _, s in held]}, types)
                    held, most = [], 0
            if held:
                yield record_batch({"node": [n for n, _ in held], "data": [s.tobytes() for _, s in held]}, types)

    found = rows.mapInArrow(run, schema)
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("data").alias("data"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that are linked."""
    types = fields(StructType.fromDDL("u long, v long"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "a"):
                u, v = part.column("u").to_pylist(), part.column("v").to_pylist()
                good = []
                for k, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    if linked(min(len(x), len(y)), len(x), len(y)) and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                        good.append(k)
                yield record_batch({"u": [u[k] for k in good], "v": [v[k] for k in good]}, types)

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("data").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("data").alias("b")), "v")
    return both.mapInArrow(run, "u long, v long")


def decide(nodes: np.ndarray, comps: np.ndarray, data: list[bytes]) -> list[tuple[int, int]]:
    """Links between the groups of some sets, as many as connect what is linked.

    The overlap of all of them comes from products of incidence matrices over shingles that at least two have.
    """
    _, first = np.unique(nodes, return_index=True)
    comp, n = comps[first], len(first)
    sets = [np.frombuffer(data[k], np.uint64) for k in first]
    size = np.array([len(s) for s in sets])
    which, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, keep = np.repeat(np.arange(n), size), counts[at] > 1
    column = (np.cumsum(counts > 1) - 1)[at[keep]]
    row, common = row[keep], np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 8192
    for start in range(0, int((counts > 1).sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        common += m @ m.T
    good = linked(common.astype(np.int64), size[:, None], size[None, :]) & (comp[:, None] != comp[None, :])
    parent: dict[int, int] = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(good)), strict=True):
        a, b = top(comp[i]), top(comp[j])
        if a != b:
            parent[a] = b
            out.append((int(comp[i]), int(comp[j])))
    return out


def _decided(members: pa.Table) -> pa.Table:
    found = decide(members.column("node").to_numpy(), members.column("comp").to_numpy(), members.column("data").to_pylist())
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _could_link(a: str, b: str):
    """Whether sets of two blocks could be linked, by the blocks' sizes and the largest partners of their sets, and aren't all of
    one group."""
    a, b = ({c: F.col(f"{x}.{c}") for c in ("pure", "lo", "hi", "most")} for x in (a, b))
    near = (OF * b["hi"] >= NEEDED * a["lo"]) & (OF * a["hi"] >= NEEDED * b["lo"]) & (b["lo"] <= a["most"]) & (a["lo"] <= b["most"])
    return near & ~F.coalesce(a["pure"] == b["pure"], F.lit(False))


def _block_pairs(of_list: DataFrame) -> DataFrame:
    """a, b: the blocks that share a list and could have linked sets, a <= b; ``of_list``: key, block, pure, lo, hi, most.

    A list of up to HELD blocks is a row, and equal rows are one. Of longer lists, those of equal blocks (by their number, and
    the xor and the sum of their hashes) are one; its blocks meet by a join, in parts of some HELD blocks with all the others.
    """
    h = [F.xxhash64("block", F.lit(k)) for k in (1, 2)]
    sizes = of_list.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(h[0]).alias("x"), F.sum(F.shiftright(h[1], 20)).alias("y"))
    one = sizes.where(f"m > {HELD}").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / HELD).alias("parts"))
    few = of_list.join(sizes.where(f"m <= {HELD}").select("key"), "key", "left_semi")
    rows = few.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("block", "pure", "lo", "hi", "most"))).alias("bs")).select("bs").distinct()
    held = rows.withColumn("a", F.explode("bs")).select("a", F.explode("bs").alias("b"))
    long = of_list.join(one, "key").select("key", "parts", F.struct("block", "pure", "lo", "hi", "most").alias("s"))
    left = long.select("key", F.pmod(F.xxhash64("s.block"), "parts").alias("part"), F.col("s").alias("a"))
    right = long.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("s").alias("b"))
    met = left.join(right, ["key", "part"]).select("a", "b")
    return held.union(met).where((F.col("a.block") <= F.col("b.block")) & _could_link("a", "b")).select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()


def _across(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between groups that share a list; ``lists``: key, node, n, most, comp, low (the least comp of the list), only
    lists over several groups.

    Members of lists with one least group are dealt to blocks: where they are many, members of one large group, and else
    sets of one class of sizes (the more there are, the narrower). Two blocks that share a list meet unless both are of one
    group or no sizes in them could be linked.
    """
    wide, narrow = (F.floor(F.log("n") / float(np.log(step))) for step in (OF / NEEDED, 1.04))
    place = lists.groupBy("node").agg(F.first("comp").alias("comp"), F.min("low").alias("place"), F.first("n").alias("n"), F.first("most").alias("most"))
    own = place.groupBy("place", "comp").agg(F.count("*").alias("m"))
    own = own.withColumn("pure", F.when(F.col("m") >= BLOCK // 2, F.col("comp"))).drop("m")
    sized = place.join(own, ["place", "comp"])
    full = sized.groupBy("place", "pure").agg(F.count("*").alias("all"))
    same = lambda a, b: (F.col(f"{a}.place") == F.col(f"{b}.place")) & F.col(f"{a}.pure").eqNullSafe(F.col(f"{b}.pure"))
    only = F.when(F.col("all") <= BLOCK, -1).when(F.col("all") <= 16 * BLOCK, wide).otherwise(narrow).alias("only")
    sized = sized.alias("x").join(full.alias("y"), same("x", "y")).select("node", "comp", "n", "most", "x.place", "x.pure", only)
    sized = stored(sized, "sized")
    many = sized.groupBy("place", "pure", "only").agg(F.count("*").alias("all"))
    dealt = sized.alias("x").join(many.alias("y"), same("x", "y") & (F.col("x.only") == F.col("y.only")))
    nth = F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / BLOCK))
    block = F.xxhash64("x.place", F.coalesce("x.pure", F.lit(0)), F.col("x.pure").isNull(), "x.only", nth).alias("block")
    dealt = stored(dealt.select("node", "comp", "n", "most", F.col("x.pure").alias("pure"), block), "blocks")
    ranges = dealt.groupBy("block").agg(F.first("pure").alias("pure"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("most").alias("most"))
    of_list = lists.select("key", "node").join(dealt.select("node", "block"), "node").select("key", "block").distinct().join(ranges, "block")
    of_list = stored(of_list, "blocks-of-lists")
    pairs = stored(_block_pairs(of_list), "block-pairs")
    forget(sized, of_list)
    sides = pairs.select("a", "b", F.col("a").alias("block")).union(pairs.where("a <> b").select("a", "b", F.col("b").alias("block")))
    members = sides.join(dealt.select("node", "comp", "block"), "block").select("a", "b", "node", "comp").join(sets, "node")
    links = stored(members.groupBy("a", "b").applyInArrow(lambda m: _decided(m), "u long, v long"), "links-across")
    forget(dealt, pairs)
    return links


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, root for every row of ``docs`` (doc_id, text): rows of one component have one root. Rows
    without words are in one component if they are repeated."""
    docs = docs.select("doc_id", "text")
    rows = surveyed = stored(_survey(docs), "shingles")
    two = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    shared = frozenset(r.node for r in two.select("node").collect())  # n sets have about n * n / 2 ** 65 such
    if shared:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*shared), F.col("other")).otherwise(F.col("node")))
    nodes = rows.where("n_shingles > 2").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    wanted = nodes.join(_lonely(docs, shared), "node", "left").where(f"coalesce(alone, 0) <= n - ceil({NEEDED} * n / {OF})").select("node", "doc_id")
    wanted = stored(wanted, "wanted")
    sets = stored(_sets_of(docs, wanted, shared), "sets")
    prefixes = stored(_prefixes(sets), "prefixes")
    lists = stored(_lists(prefixes), "lists")
    forget(wanted, prefixes)
    sizes = f"{OF} * least(n, first_n) >= {NEEDED} * greatest(n, first_n) and n <= first_most and first_n <= most"
    pairs = lists.where(f"node <> first and {sizes}").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    roots = components(_verified(pairs, sets))
    placed = lists.join(roots, "node", "left").select("key", "node", "n", "most", F.coalesce("root", "node").alias("comp"))
    placed = stored(placed, "placed")
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "low")
    across = stored(placed.join(several, "key"), "across")
    forget(lists, placed)
    links = _across(across, sets)
    merged = components(links)
    forget(across, links, sets)
    to_top = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    own = F.xxhash64("doc_id", "text_hash", F.lit("no words"))
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node", own)).join(to_top, "root", "left")
    named = stored(named.select("doc_id", "text_hash", "n_shingles", F.coalesce("top", "root").alias("root")), "components")
    forget(surveyed, roots, merged)
    return named


def join_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two documents link when their sets of 5-word shingles have at least 75 of 100 of their union in common; component_id is
    the least doc_id that links reach. Null texts and texts without words have an empty set and link with nothing (their
    component is their own doc_id); texts of fewer than five words have one shingle of them all; equal sets are one set.
    Repeated rows are in one component; rows of one doc_id and different texts are nodes of their own; other columns are not
    looked at; an empty table gives an empty table.

    Rows shuffled: a shingle and a node for about a third of the shingles, and whole sets only of documents that may have a
    partner.
    """
    named = _grouped(docs)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` without all but one of each component: that of the least doc_id, and of its texts that of the
    least hash, in one row.

    Rows without doc_id are kept if their component has no other: one row of each such component. Of repeated rows that differ in
    other columns, the one whose other columns come first as JSON text stays. Null and empty texts are alone in their
    component, but repeated rows of them are one; texts of any length are compared whole; all columns stay, whatever their
    names; an empty table gives an empty table.
    """
    named = _grouped(docs)
    own_id, own_hash, of_text = free_names(docs, 3)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    first = stored(first.select(F.col("x.doc_id").alias(own_id), F.col("x.text_hash").alias(own_hash)).distinct(), "kept")
    row = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(of_text) == F.col(own_hash))
    kept = docs.withColumn(of_text, F.expr(TEXT_HASH)).join(first, row, "left_semi")
    again = named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    again = stored(again, "repeated-rows")
    if not again.limit(1).count():
        return kept.drop(of_text)
    single = kept.join(again, row, "left_anti").drop(of_text)
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias(own_id)))
    one = kept.join(again, row, "left_semi").groupBy("doc_id", of_text).agg(F.min_by(F.struct(*docs.columns), others).alias(own_id))
    return single.unionByName(one.select(f"{own_id}.*"))
