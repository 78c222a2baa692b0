"""MinHash near-dedup by chosen-path set similarity join.

Documents with one shingle set are one class, and the join runs over classes. ``TREES``
independent trees branch the classes: a node sends each member to one child for each of its
two chosen minwise tokens, named after the token's value, so two sets of similarity s meet
again in a child with probability s for each choice. No path uses a token twice. Nodes of at
most ``LEAF`` members are compared exhaustively. A larger node is dense if a sample shows that
most of its members are as like to one of a few pivots as linked sets are, so that branching
would not part it (nodes without tokens left are treated alike). Dense nodes with nearly the same
members are one. Their members are compared in blocks that share pivots; then the members outside
the node's largest component meet all members, block by block, two blocks a group, so that no group
grows with the node. Nodes of up to ``SUBTREE`` members are branched to their leaves by one task.

Comparing uses 128-value sketches. Of a node's candidate pairs the heaviest spanning forest is
confirmed on the full shingle sets. What other pairs join between different components goes on as
members, not as pairs: the task of each such part holds all its pairs against each other on the full
sets and returns the links that join components, so any group, of copies or of texts that are
half alike, gives rows in proportion to its size; components come from
alternating large-star and small-star steps, few links are joined by one task. A pair at the threshold misses one choice with
probability 1/4, and 12 root choices meet it with probability 1 - 6e-8; below the root two
choices a node keep a pair with probability 0.89 in each of the six trees, so that all six lose
it with probability 0.11 ** 6 = 1.8e-6. All trees use one sketch, which loses 3.4e-10 more.

Defined results: NULL text is empty; a document without words has an empty set, is linked
with nothing and is its own component; rows without id take their class's component (NULL if
no member has an id) and are not kept; rows that repeat an id are in the component of their
own text; an empty table gives no rows; columns other than id and text, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import (SLICE_BYTES, join_hot, mixed, run_hashes, space_words, staged, text_or_empty,
                              text_slices, word_hashes)

SHINGLE = 5
#: links: 100 * intersection >= PERCENT * union
PERCENT = 75
TREES = 6
ROOT_CHOICES = 2 * TREES
#: minwise tokens for branching (the first ROOT_CHOICES at the roots) and sketch values
TOKENS, SKETCH = 32, 128
LEAF = 256
#: nodes with this share of members that are like a pivot are dense
DENSE = 0.75
#: nodes with less than this share of their parent are branched without a look at their sketches
LOOK = 0.5
#: a path takes one token at the root and the others below
MAX_DEPTH = 1 + TOKENS - ROOT_CHOICES
PIVOTS = 8
#: members by which a node is judged dense
SAMPLE = 256
#: sketch likeness below which a pair is no candidate (a pair at the threshold has less with
#: probability 3.4e-10: at most 63 of 128 values agree)
LEAST_LIKENESS = 0.5
MULTIPLIERS = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
#: shingles that are hashed together: their hashes stay in a core's cache
TOGETHER = 256
#: members of a dense node of which one names it
HUBS = 8
#: members up to which a large node is branched to its leaves by one task
SUBTREE = 1 << 15
#: links up to which components are joined by one task
FEW_LINKS = 1 << 18


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    words = space_words(texts, lower=True)
    hashes = word_hashes(words.distinct)[words.codes]
    runs = run_hashes(hashes, shingle)
    start = 0
    for end in words.ends.tolist():
        n = end - start
        yield np.unique(runs[start:end - shingle + 1]) if n >= shingle else run_hashes(hashes[start:end], n)[:1 if n else 0]
        start = end


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        a, b = mixed(hashes).sum(dtype=np.uint64), mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least of SKETCH hashes over the set."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), TOGETHER):
            part = hashes[i:i + TOGETHER, None] * MULTIPLIERS
            least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(0))
    return least


def sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, key, tokens, sketch``; key and the rest are NULL for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            sizes, keys, tokens, marks = [], [], [], []
            for hashes in shingle_sets(batch.column(1)):
                sizes.append(len(hashes))
                if len(hashes):
                    least = minwise(hashes)
                    keys.append(set_key(hashes))
                    tokens.append((least[:TOKENS] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    marks.append((mixed(least) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    tokens.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int32())), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "key", "tokens", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, key binary, tokens array<int>, sketch binary")


def branch(nodes: DataFrame, choices: Column) -> DataFrame:
    """``parent, node, used, key``: a row for each member of a node and each of its choices, with
    the bits of the tokens that the path has used."""
    return (nodes.withColumn("choice", F.explode(choices))
            .select(F.col("node").alias("parent"),
                    F.xxhash64("node", "choice", F.element_at("tokens", F.col("choice") + 1)).alias("node"),
                    F.col("used").bitwiseOR(F.expr("shiftleft(1L, choice)")).alias("used"), "key"))


def unused_choices() -> Column:
    """Two tokens (one, if only one is left) that the path of ``node, used`` has not used."""
    unused = F.filter(F.sequence(F.lit(ROOT_CHOICES), F.lit(TOKENS - 1)), lambda i: F.getbit("used", i) == 0)
    n = F.size(unused)
    one = F.pmod(F.xxhash64("node", F.lit(1)), n)
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(n - 1, F.lit(1))), n)
    return F.array_distinct(F.array(*(F.element_at(unused, (i + 1).cast("int")) for i in (one, two))))


def alike(marks: np.ndarray) -> bool:
    """Whether most sketches are as like to one of the first PIVOTS as linked sets are."""
    pivots, rest = marks[:PIVOTS], marks[PIVOTS:]
    if not len(rest):
        return False
    best = np.max([(rest == p).mean(1) for p in pivots], axis=0)
    return bool((best >= PERCENT / 100).mean() >= DENSE)


def dense_nodes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``node`` of those whose members (``node, size, key``) are alike, judged by some SAMPLE of them."""
    place = F.xxhash64("key", "node")
    some = members.filter(F.pmod(place, F.ceil(F.col("size") / SAMPLE).cast("long")) == 0).select("node", "key", place.alias("place"))
    lists = (some.join(classes.select("key", "sketch"), "key").groupBy("node")
             .agg(F.sort_array(F.collect_list(F.struct("place", "sketch")))["sketch"].alias("marks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = [alike(np.frombuffer(b"".join(x.as_py()), np.uint8).reshape(-1, SKETCH)) for x in batch.column(1)]
            yield batch.select(["node"]).filter(pa.array(dense, pa.bool_()))

    return lists.mapInArrow(run, "node long")


NODE = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("key", pa.binary())])


def subtrees(nodes: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Nodes ``node, used, look, key`` of depth ``depth`` branched as ``branch`` does, each by one
    task: ``node, size, key`` of their leaves and dense nodes, those with the same members once."""
    rows = (nodes.join(classes.select("key", "tokens", "sketch"), "key").select("node", "key", "tokens", "sketch", "used", "look")
            .repartition("node").sortWithinPartitions("node", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for node, (keys, tokens, marks, used, look) in by_group(batches, named=True):
                found = ends_of_tree(node, int(used[0]), bool(look[0]), depth, np.stack(tokens), marks_of(marks))
                yield from ((name, len(own), keys[i]) for name, own in found for i in own.tolist())

        yield from batches_of(members(), NODE)

    return rows.mapInArrow(run, "node long, size long, key binary")


def ends_of_tree(node: int, used: int, look: bool, depth: int, tokens: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The leaves and dense nodes below a node and their members; leaves have at most LEAF."""
    todo, seen = [(node, used, look, depth, np.arange(len(tokens)))], set()
    while todo:
        node, used, look, depth, own = todo.pop()
        if len(own) > LEAF and depth < MAX_DEPTH:
            some = np.random.default_rng(node & (1 << 64) - 1).permutation(own)[:SAMPLE] if look else own[:0]
            if not alike(marks[some]):
                unused = [i for i in range(ROOT_CHOICES, TOKENS) if not used >> i & 1]
                for choice in np.random.default_rng([node & (1 << 64) - 1, 1]).permutation(unused)[:2].tolist():
                    order = own[np.argsort(tokens[own, choice], kind="stable")]
                    values, starts = np.unique(tokens[order, choice], return_index=True)
                    for value, part in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                        if len(part) > 1:
                            name = xxhash.xxh3_64_intdigest(np.array([node, choice, value], np.int64).tobytes()) - (1 << 63)
                            todo.append((name, used | 1 << choice, len(part) >= LOOK * len(own), depth + 1, part))
                continue
        members = xxhash.xxh3_128_digest(own.tobytes())
        if members not in seen:
            seen.add(members)
            yield node, own


def tree_groups(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The small nodes of all trees as ``grp, key``, and the dense ones as ``node, size, key``."""
    tokens = classes.select("key", "tokens")
    roots = tokens.withColumn("node", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
    rows = staged(branch(roots, F.sequence(F.lit(0), F.lit(ROOT_CHOICES - 1))), "roots")
    above = None
    leaves, dense = [], []
    for depth in range(1, MAX_DEPTH + 1):
        sizes = rows.groupBy("parent", "node", "used").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        if above is None:
            sizes = sizes.withColumn("whole", F.lit(1 << 62))
        else:
            sizes = sizes.join(above.select(F.col("node").alias("parent"), F.col("size").alias("whole")), "parent")
        look = F.col("size") >= LOOK * F.col("whole")
        kind = (F.when(F.col("size") <= LEAF, F.lit("leaf")).when(F.lit(depth == MAX_DEPTH), F.lit("dense"))
                .when(F.col("size") <= SUBTREE, F.when(look, F.lit("subtree, look")).otherwise(F.lit("subtree")))
                .when(look, F.lit("look")).otherwise(F.lit("big")))
        sizes = staged(sizes.select("node", "size", "used", kind.alias("kind")), "sizes")
        kinds = {r["kind"] for r in sizes.select("kind").distinct().collect()}
        if "look" in kinds:
            look = rows.select("node", "key").join(sizes.filter("kind = 'look'").select("node", "size"), "node")
            found = dense_nodes(look, classes).withColumn("found", F.lit(True))
            kind = F.when(F.col("kind") != "look", F.col("kind")).when(F.col("found"), F.lit("dense")).otherwise(F.lit("big"))
            sizes = staged(sizes.join(found, "node", "left").select("node", "size", "used", kind.alias("kind")), "sizes")
            kinds = {r["kind"] for r in sizes.select("kind").distinct().collect()}
        member = rows.select("node", "key").join(sizes, "node")
        if "leaf" in kinds:
            leaves.append(staged(member.filter("kind = 'leaf'").select(F.col("node").alias("grp"), "key"), "leaves"))
        if "dense" in kinds:
            dense.append(staged(member.filter("kind = 'dense'").select("node", "size", "key"), "dense"))
        if kinds & {"subtree", "subtree, look"}:
            small = member.filter("kind like 'subtree%'").select("node", "used", (F.col("kind") != "subtree").alias("look"), "key")
            found = staged(subtrees(small, classes, depth), "subtrees")
            leaves.append(found.filter(F.col("size") <= LEAF).select(F.col("node").alias("grp"), "key"))
            dense.append(found.filter(F.col("size") > LEAF))
        if "big" not in kinds:
            break
        above = sizes.filter("kind = 'big'").select("node", "size")
        rows = staged(branch(member.filter("kind = 'big'").select("node", "used", "key").join(tokens, "key"), unused_choices()), "branch")

    def together(parts: list[DataFrame]) -> DataFrame | None:
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    empty = classes.select(F.lit(0).cast("long").alias("grp"), "key").limit(0)
    found = together(dense)
    return together(leaves) if leaves else empty, found if found is not None and found.take(1) else None


def merged(dense: DataFrame) -> DataFrame:
    """Dense nodes ``node, size, key`` with one hub as one node. A node's hub is that of its least
    members by HUBS hashes which most nodes have. The nodes that a group of like texts makes in all
    trees have nearly the same members, so most of them have the same hub, and the group is compared
    once or twice instead of once for each node."""
    least = dense.groupBy("node").agg(F.array(*(F.min(F.xxhash64("key", F.lit(i))) for i in range(HUBS))).alias("hubs"))
    least = staged(least.select("node", F.explode("hubs").alias("hub")), "hubs")
    often = least.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    hubs = least.join(often, "hub").groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    members = dense.join(hubs, "node").select(F.col("hub").alias("node"), "key").distinct()
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    return staged(members.join(sizes, "node").select("node", "size", "key"), "merged")


def blocks(dense: DataFrame) -> DataFrame:
    """Dense nodes as groups ``grp, key`` of some LEAF members, each with the node's PIVOTS
    first members by hash."""
    place = F.xxhash64("node", "key")
    n_blocks = F.ceil(F.col("size") / LEAF).cast("long")
    own = dense.select(F.xxhash64("node", F.pmod(place, n_blocks)).alias("grp"), "key")
    # the first members by hash: the least of each of PIVOTS parts, which merges map-side
    first = (dense.groupBy("node", "size", F.pmod(F.xxhash64("key", "node"), F.lit(PIVOTS)).alias("part"))
             .agg(F.min(F.struct(place.alias("place"), F.col("key"))).alias("least"))
             .select("node", "size", F.col("least.key").alias("key")))
    shared = (first.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
              .select(F.xxhash64("node", "block").alias("grp"), "key"))
    return own.unionByName(shared).distinct()


def block_pairs(dense: DataFrame, out: DataFrame) -> DataFrame:
    """Groups ``grp, key`` in which every row of ``out`` (node, key) meets every member of its
    dense node: some LEAF members with some LEAF of ``out`` each, whatever the node's size."""
    place = F.xxhash64("node", "key")
    counts = (out.groupBy("node").agg(F.count(F.lit(1)).alias("outside"))
              .join(dense.groupBy("node").agg(F.max("size").alias("size")), "node")
              .select("node", *(F.ceil(F.col(c) / LEAF).cast("long").alias(n) for c, n in (("size", "n_own"), ("outside", "n_out")))))

    def dealt(rows: DataFrame, own: str, others: str) -> DataFrame:
        dealt = rows.select("node", "key").join(counts, "node").withColumn(own, F.pmod(place, F.col(f"n_{own}")))
        dealt = dealt.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{others}") - 1)))
        return dealt.select(F.xxhash64("node", "own", "out").alias("grp"), "key")

    return dealt(dense, "own", "out").unionByName(dealt(out, "out", "own")).distinct()


def with_sketches(groups: DataFrame, classes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``grp, key, sketch, root`` by group; with the components ``roots`` (key, root) found so far,
    only of groups that hold several."""
    sketch = classes.select("key", "sketch")
    if roots is None:
        rows = groups.join(sketch, "key").withColumn("root", F.col("key"))
    else:
        rows = groups.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = (rows.groupBy("grp").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("grp"))
        rows = rows.join(several, "grp", "left_semi").join(sketch, "key")
    return rows.select("grp", "key", "sketch", "root").repartition("grp").sortWithinPartitions("grp", "key")


def by_group(batches: Iterator[pa.RecordBatch], named: bool = False) -> Iterator:
    """The columns after the first of each run of rows with one first value; ``named``: with that value."""
    def columns() -> list[list] | tuple:
        own = [list(c) for c in zip(*held, strict=True)]
        return (now, own) if named else own

    now, held = None, []
    for batch in batches:
        for grp, *row in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
            if grp != now:
                if held:
                    yield columns()
                now, held = grp, []
            held.append(row)
    if held:
        yield columns()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
MEMBER = pa.schema([("grp", pa.int64()), ("key", pa.binary()), ("root", pa.binary())])


def candidate_pairs(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """The heaviest spanning forest ``a, b`` of the candidate pairs of each group ``grp, key``, each
    pair once."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for keys, marks, _ in by_group(batches):
            if len(keys) > 1:
                for i, j in spanning_forest(marks_of(marks)):
                    yield min(keys[i], keys[j]), max(keys[i], keys[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(pairs(batches), PAIR)

    return with_sketches(groups, classes).mapInArrow(run, "a binary, b binary").distinct()


def undecided(groups: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``grp, key, root``: what candidate pairs between different components ``roots`` join within a
    group ``grp, key``. A row for each member, however many pairs it is in; parts with the same
    members have one ``grp`` and are kept once."""
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for keys, marks, owners in by_group(batches):
            if len(keys) > 1:
                for part in joined(across(marks_of(marks), owners)):
                    own = [keys[i] for i in part]
                    grp = xxhash.xxh3_64_intdigest(b"".join(own)) - (1 << 63)
                    yield from ((grp, keys[i], owners[i]) for i in part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(members(batches), MEMBER)

    return with_sketches(groups, classes, roots).mapInArrow(run, "grp long, key binary, root binary").distinct()


def marks_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)


def likenesses(marks: np.ndarray) -> np.ndarray:
    like, values = np.zeros((len(marks), len(marks)), np.float32), np.ascontiguousarray(marks.T)
    for i, own in enumerate(marks):
        like[i] = (values == own[:, None]).sum(0, dtype=np.uint8) / np.float32(SKETCH)
    np.fill_diagonal(like, 0)
    return like


def spanning_forest(marks: np.ndarray) -> list[tuple[int, int]]:
    """The heaviest spanning forest of the pairs of at least LEAST_LIKENESS."""
    n = len(marks)
    if n == 2:
        return [(0, 1)] if (marks[0] == marks[1]).mean() >= LEAST_LIKENESS else []
    like = likenesses(marks)
    out = []
    best, source, todo = like[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    todo[0] = False
    for _ in range(1, n):
        i = int(np.where(todo, best, -1).argmax())
        todo[i] = False
        if best[i] >= LEAST_LIKENESS:
            out.append((int(source[i]), i))
        closer = like[i] > best
        best[closer], source[closer] = like[i][closer], i
    return out


def across(marks: np.ndarray, roots: list[bytes]) -> np.ndarray:
    """Whether two members are a candidate pair whose ends have different roots."""
    _, part = np.unique(np.array(roots, object), return_inverse=True)
    return (likenesses(marks) >= LEAST_LIKENESS) & (part[:, None] != part[None, :])


def between(marks: np.ndarray, roots: list[bytes]) -> list[tuple[int, int]]:
    """The candidate pairs whose ends have different roots."""
    a, b = np.nonzero(np.triu(across(marks, roots), 1))
    return list(zip(a.tolist(), b.tolist(), strict=True))


def joined(pairs: np.ndarray) -> list[list[int]]:
    """The connected parts of a symmetric matrix of pairs; those without a pair are left out."""
    n = len(pairs)
    least, before = np.arange(n), None
    while before is None or (least != before).any():
        before = least
        least = np.minimum(least, np.where(pairs, least[None, :], n).min(1))
    some = np.flatnonzero(pairs.any(1))
    return [some[least[some] == x].tolist() for x in np.unique(least[some])]


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough; ``texts``: key, packed."""
    rows = (pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("packed").alias("text_a")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("packed").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in text_slices(whole, 2, SLICE_BYTES >> 3)):
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            packed = dict(zip(a + b, text_a + text_b, strict=True))
            texts = pa.array([unpack.decompress(t).decode() for t in packed.values()], pa.large_string())
            sets = dict(zip(packed, shingle_sets(texts), strict=True))
            kept = []
            for i, (one, other) in enumerate(zip(a, b, strict=True)):
                both = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
                if 100 * both >= percent * (len(sets[one]) + len(sets[other]) - both):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, "a binary, b binary")


def linked_within(groups: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` between different roots: all pairs of each group ``grp, key, root`` are held
    against each other on their full shingle sets, and of the links those that join parts not
    joined yet are returned, as their ends' roots, less than the group has. ``texts``: key, packed."""
    rows = (groups.join(texts, "key").select("grp", "key", "root", "packed").repartition("grp").sortWithinPartitions("grp", "key"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()

        def sets_of(packed: list[bytes]) -> list[np.ndarray]:
            return list(shingle_sets(pa.array([unpack.decompress(p).decode() for p in packed], pa.large_string())))

        for _, owners, packed in by_group(batches):
            _, part = np.unique(np.array(owners, object), return_inverse=True)
            sizes = np.cumsum([zstandard.frame_content_size(p) for p in packed]) // SLICE_BYTES
            cuts = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1)).tolist()
            blocks = list(zip(cuts[:-1], cuts[1:], strict=True))
            for n, (start, stop) in enumerate(blocks):
                own = sets_of(packed[start:stop])
                for first, last in blocks[n:]:
                    if (part[start:stop] == part[start]).all() and (part[first:last] == part[start]).all():
                        continue
                    others = own if first == start else sets_of(packed[first:last])
                    for i, like in enumerate(similar(own, others, percent), start):
                        while (new := np.flatnonzero(like & (part[first:last] != part[i]))).size:
                            j = first + int(new[0])
                            yield min(owners[i], owners[j]), max(owners[i], owners[j])
                            part[part == part[j]] = part[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(links(batches), PAIR)

    return rows.mapInArrow(run, "a binary, b binary").distinct()


def similar(own: list[np.ndarray], others: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """For each set of ``own``, which of ``others`` (none is empty) are similar enough; where both are
    one list, of the others than itself."""
    sizes = np.array([len(x) for x in others])
    for one, both in zip(own, shared(own, others), strict=True):
        yield 100 * both >= percent * (len(one) + sizes - both)


def shared(own: list[np.ndarray], others: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """How many values each set of ``own`` has in common with each of ``others``, by products of 0/1
    matrices, ``wide`` of the values that both sides have at a time. Where both are one list, values
    of one set only are left out, so what a set has in common with itself is not counted whole."""
    values, codes = np.unique(np.concatenate(others), return_inverse=True)
    flat = np.concatenate(own)
    at = np.searchsorted(values, flat)
    at[at == len(values)] = 0
    found = np.zeros(len(values), bool)
    found[at[values[at] == flat]] = True
    if own is others:
        found &= np.bincount(codes, minlength=len(values)) > 1
    place = np.cumsum(found) - 1

    def dealt(sets: list[np.ndarray], at: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, columns = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[here], place[at[here]]
        order = np.argsort(columns // wide, kind="stable")
        rows, columns = rows[order], columns[order]
        return rows, columns % wide, np.searchsorted(columns // wide, np.arange(-(-int(found.sum()) // wide) + 1))

    one, other = dealt(own, at, found[at] & (values[at] == flat)), dealt(others, codes, found[codes])
    out = np.zeros((len(own), len(others)), np.int64)
    for n in range(len(one[2]) - 1):
        sides = []
        for sets, (rows, columns, cuts) in ((own, one), (others, other)):
            side = np.zeros((len(sets), wide), np.float32)
            side[rows[cuts[n]:cuts[n + 1]], columns[cuts[n]:cuts[n + 1]]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


ROOT = pa.schema([("key", pa.binary()), ("root", pa.binary())])


def joined_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, root`` of the ends of all edges ``u, v`` of the batches."""
    above: dict[bytes, bytes] = {}

    def top(key: bytes) -> bytes:
        at = key
        while above.setdefault(at, at) != at:
            at = above[at]
        while above[key] != at:
            above[key], key = at, above[key]
        return at

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            least, other = sorted((top(u), top(v)))
            above[other] = least
    yield from batches_of(((key, top(key)) for key in above), ROOT)


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``key, root`` after links ``a, b`` between roots (or keys that are in no component yet)."""
    now = staged(components(links), "joined")
    known = roots.join(now.select(F.col("key").alias("root"), F.col("root").alias("now")), "root", "left")
    fresh = now.join(roots.select("key"), "key", "left_anti")
    return staged(known.select("key", F.coalesce("now", "root").alias("root")).unionByName(fresh), "roots")


def components(links: DataFrame) -> DataFrame:
    """``key, root`` (the least key of its component) of every end of a link ``a, b``: up to
    FEW_LINKS links by one task, more by alternating large-star and small-star steps."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(joined_by_one, "key binary, root binary")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(roots)
        before = now


def ends(pairs: DataFrame) -> DataFrame:
    """``key`` of both ends of each pair."""
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def packed_texts(rows: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, packed``: the compressed text of each class of ``keys`` (key, may repeat)."""
    some = classes.select(F.col("doc_id").alias("lender"), "key").join(keys.distinct(), "key", "left_semi")
    texts = rows.join(some, F.col("doc_id").eqNullSafe(F.col("lender"))).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in (part for whole in batches for part in text_slices(whole)):
            # a repeated id may have other texts besides the class's
            own = [i for i, (key, found) in enumerate(zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True))
                   if set_key(found) == key]
            batch = batch.take(pa.array(own, pa.int64()))
            packed = [pack.compress(t.as_py().encode("utf-8", "replace")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "packed"])

    return staged(texts.mapInArrow(run, "key binary, packed binary").dropDuplicates(["key"]), "texts")


def link_classes(classes: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key, root`` of the classes that have links."""
    leaves, dense = tree_groups(classes)
    if dense is not None:
        dense = merged(dense)
    groups = leaves if dense is None else staged(leaves.unionByName(blocks(dense)), "groups")
    tried = staged(candidate_pairs(groups, classes), "pairs")
    # a member that has a candidate in its group is an end of the group's forest, so later steps need
    # no other texts than these
    keys = ends(tried) if dense is None else ends(tried).unionByName(dense.select("key"))
    texts = packed_texts(rows, classes, keys)
    links = staged(confirmed(tried, texts, percent), "links")
    roots = staged(components(links), "roots")

    def join_more(groups: DataFrame) -> None:
        """Decide what is left between components, and join those that it links."""
        nonlocal roots
        late = staged(undecided(groups, classes, roots), "undecided")
        if not late.take(1):
            return
        more = staged(linked_within(late, texts, percent), "links")
        if more.take(1):
            roots = joined_roots(roots, more)

    join_more(groups)
    if dense is not None:
        # members of dense nodes outside the node's largest component meet all members
        own = dense.join(roots, "key", "left").select("node", "key", F.coalesce("root", "key").alias("root"))
        main = (own.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
        out = staged(own.join(main, "node").filter("root != main").select("node", "key"), "outside")
        if out.take(1):
            join_more(staged(block_pairs(dense.join(out.select("node").distinct(), "node", "left_semi"), out), "groups"))
    return roots


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketch = staged(sketches(rows), "sketches")
    total = sketch.count()
    groups = staged(sketch.filter("key is not null").groupBy("key")
                    .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size")), "classes")
    # one row of each class lends its tokens, sketch and text: the first with the class's least id
    lender = sketch.select("doc_id", "key", "tokens", "sketch").join(
        groups.select("key", "first_id"), "key").filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    classes = staged(lender.dropDuplicates(["key"]).select("key", "doc_id", "tokens", "sketch"), "lenders")
    roots = link_classes(classes, rows, percent)
    linked = (groups.join(roots, "key", "left").select("key", "size", "first_id", F.coalesce("root", "key").alias("root")))
    linked = staged(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_key = staged(join_hot(linked, least, "root", "n", linked.count()).select("key", "size", "component_id"), "by_key")
    found = join_hot(sketch.filter("key is not null").select("doc_id", "n_shingles", "key"), by_key, "key", "size", total)
    alone = sketch.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
