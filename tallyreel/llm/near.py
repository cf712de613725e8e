"""Near-duplicate groups by a chosen-path similarity join.

Every document gets minwise tokens of its set of word shingles, kept as a sketch of one byte
each. A tree starts with all documents in one node. At each node a random coordinate, and now
and then a second one, is chosen by the node's path, and documents go on to the child that their
token there names. A node with few documents is compared exhaustively; a larger one whose documents
agree in many places, as no further branching would part them, is one cluster; any other
branches again. A pair at the threshold keeps more than one node in common on average at every
level, and trees are repeated over several sets of coordinates. ``miss_bound`` computes with which
probability all trees, or the comparison of sketches, miss such a pair; for 40 levels it is
below 1e-4 from 80 percent on, and a pair above the threshold is missed far more rarely.

Comparisons in nodes use the sketches and only collect documents that may be linked
into clusters. Links are confirmed on the full sets, cluster by cluster. A large cluster is
dealt to blocks that share pivots; documents that don't come to hang on its largest part are
then compared with every block, so no link between two blocks is lost. A block holds so many
documents that even a family of a hundred thousand has some fifty blocks.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreel.llm import storage
from tallyreel.llm.components import components
from tallyreel.llm.exchange import changes
from tallyreel.llm.hashing import Words, mix, slices, text_bytes
from tallyreel.llm.storage import Settle

TREES = 12
# Trees take turns at these sets of coordinates, so those of two sets fail independently.
COORDINATE_SETS, SET_COORDINATES = 3, 64
COORDINATES = COORDINATE_SETS * SET_COORDINATES
# Children that a pair at the threshold has in common on average; above 1 it may last for ever.
COMMON_CHILDREN = 1.25
# Probability with which the comparison of tokens may miss a pair at the threshold.
UNLIKELY = 3e-5
# Nodes of at most this many documents are compared exhaustively; others branch on.
SMALL_NODE = 1024
# A node whose documents agree in this share of places on average is one cluster.
DENSE = 0.5
# So many of a set's coordinates are looked at for that.
PROBES = 8
LEVELS = 40
# Documents, and elements of their sets, that a block of a large cluster holds about.
BLOCK = 2048
BLOCK_ELEMENTS = 1 << 20
PIVOTS = 8
# Documents, and elements of their sets, whose intersections are counted in one product.
TILE, TILE_ELEMENTS = 256, 1 << 17
# Numbers in one factor of it.
TILE_NUMBERS = 1 << 20
# Set elements, and rows of nodes, that one group of work holds: most and least.
TASK_ELEMENTS = 2 << 20, 1 << 15
TASK_ROWS = 1 << 15, 1 << 11

_random = np.random.default_rng(5)
_TWISTS = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_FACTORS = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_NODE = "node long, id long"
_LINK = "a long, b long"
_NODE_ARROW = pa.schema([("node", pa.int64()), ("id", pa.int64())])
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's begin."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    runs = words.runs(size, hashes)
    text = words.text_of()
    take = words.left() >= size
    short = (words.counts > 0) & (words.counts < size)
    if short.any():  # the whole sequence is the one shingle; its length keeps it apart
        for n in range(1, size):
            firsts = words.bounds[:-1][words.counts == n]
            runs[firsts] = mix(words.runs(n, hashes)[firsts] + np.uint64(n))
            take[firsts] = True
    text, runs = text[take], runs[take]
    order = np.lexsort((runs, text))
    text, runs = text[order], runs[order]
    first = changes(text, runs)
    text, runs = text[first], runs[first]
    return runs, np.searchsorted(text, np.arange(len(offsets)))


def _minwise(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One token per text and coordinate; texts without shingles have zeros."""
    out = np.zeros((len(bounds) - 1, COORDINATES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        for c in range(COORDINATES):
            values = (shingles ^ _TWISTS[c]) * _FACTORS[c]
            out[full, c] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return out


def _profile(size: int, trees: int, percent: int):
    """Set sizes, a 128-bit name of each set, its sketch, and the nodes it goes to from the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                shingles, bounds = _sets(data[offsets[a] : offsets[b]], own, size)
                counts = np.diff(bounds)
                names = [np.zeros(b - a, dtype=np.int64) for _ in range(2)]
                full = np.flatnonzero(counts)
                if len(full):
                    for name, salt in zip(names, (1, 2), strict=True):
                        sums = np.add.reduceat(mix(shingles * np.uint64(2 * salt + 1)), bounds[:-1][full])
                        name[full] = mix(sums + counts[full].astype(np.uint64)).view(np.int64)
                tokens = _minwise(shingles, bounds)
                columns = {
                    "id": batch.column("id").slice(a, b - a),
                    "n": pa.array(counts.astype(np.int64)),
                    "k": pa.array(names[0]),
                    "h": pa.array(names[1]),
                    "sketch": pa.array([t.tobytes() for t in _sketch(tokens)], pa.binary()),
                    "nodes": pa.array(list(_first_nodes(tokens, trees, percent)), pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """The low byte of each token: equal where tokens are, and elsewhere once in 256 times."""
    return tokens.astype(np.uint8)


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Sketches of one set of coordinates."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SET_COORDINATES)


def _agreements(percent: int) -> np.ndarray:
    """Probability of each number of equal tokens in one set of coordinates, at the threshold."""
    n, share = SET_COORDINATES, percent / 100
    return np.array([math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)])


def _likely_from(percent: int) -> float:
    """Agreement in the first set of coordinates from which a pair is confirmed.

    A pair at the threshold has less with a probability of UNLIKELY at most.
    """
    return int(np.searchsorted(np.cumsum(_agreements(percent)), UNLIKELY, side="right")) / SET_COORDINATES


def _second_chance(percent: int) -> float:
    """Probability of a node's second coordinate."""
    return COMMON_CHILDREN * 100 / percent - 1


def miss_bound(percent: int, levels: int, trees: int = TREES) -> float:
    """Probability that a pair at the threshold is missed in nodes of up to so many levels, or as unlikely.

    With k equal tokens in a set of coordinates, a node of the pair has a first common child
    with probability k / SET_COORDINATES, and a second with that times the second chance.
    """
    second, weight = _second_chance(percent), _agreements(percent)
    agree = np.arange(SET_COORDINATES + 1) / SET_COORDINATES
    gone = np.zeros(SET_COORDINATES + 1)
    for _ in range(levels):
        gone = (1 - agree + agree * gone) * (1 - second * agree + second * agree * gone)
    parted = 1.0
    for group in range(COORDINATE_SETS):
        parted *= float((weight * gone ** len(range(group, trees, COORDINATE_SETS))).sum())
    return parted + float(weight[agree < _likely_from(percent)].sum())


def _in_set(paths: np.ndarray, group: np.ndarray | np.uint64) -> np.ndarray:
    """Paths whose lowest bits are the set of coordinates."""
    return paths & ~np.uint64(3) | group


def _children(paths: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that documents go to from the nodes they are in, and the row of the document of each.

    ``tokens`` are those of the node's set of coordinates, which the lowest bits of its path
    name. A pair at the threshold keeps COMMON_CHILDREN of the nodes in common on average.
    """
    nodes, rows = [], []
    group = paths & np.uint64(3)
    for branch, chance in ((0, 1.0), (1, _second_chance(percent))):
        draw = mix(paths + np.uint64(branch + 1))
        goes = np.flatnonzero((draw >> np.uint64(11)).astype(np.float64) / (1 << 53) < chance)
        at = mix(draw)[goes] % np.uint64(SET_COORDINATES)
        token = tokens[goes, at.astype(np.int64)].astype(np.uint64)
        nodes.append(_in_set(mix(draw[goes] ^ mix(token + np.uint64(1))), group[goes]))
        rows.append(goes)
    return np.concatenate(nodes), np.concatenate(rows)


def _first_nodes(tokens: np.ndarray, trees: int, percent: int) -> np.ndarray:
    """The nodes that each document goes to from the roots: (documents, nodes). Whole tokens part it."""
    found = [np.zeros((len(tokens), 0), dtype=np.int64)]
    for tree in range(trees):
        group = tree % COORDINATE_SETS
        root = _in_set(mix(np.full(len(tokens), 7919 * (tree + 1), dtype=np.uint64)), np.uint64(group))
        own = tokens[:, group * SET_COORDINATES : (group + 1) * SET_COORDINATES]
        nodes, _ = _children(root, own, percent)  # all documents are in one node, so all go the same ways
        found.append(nodes.view(np.int64).reshape(-1, len(tokens)).T if len(tokens) else found[0])
    return np.concatenate(found, axis=1)


def _branch(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                paths = batch.column("node").to_numpy().view(np.uint64)
                nodes, rows = _children(paths, _sketches(batch.column("sketch")), percent)
                ids = batch.column("id").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(ids)], schema=_NODE_ARROW)

    return run


class _Forest:
    """Which of some documents are connected so far."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def _likely(sketches: np.ndarray, i: int, least: float) -> np.ndarray:
    """Which later documents agree with one in enough places."""
    agree = (sketches[i + 1 :] == sketches[i]).sum(axis=1) >= least * SET_COORDINATES
    return np.flatnonzero(agree) + i + 1


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK_ARROW)


def _compare_nodes(percent: int):
    """Links between documents of one node that may be similar; as few as connect them."""

    def run(table: pa.Table) -> pa.Table:
        node, ids = table.column("node").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, node))
        ids, sketches = ids[order], _sketches(table.column("sketch"))[order]
        least = _likely_from(percent)
        cuts = np.append(np.flatnonzero(changes(node[order])), len(order))
        twos = cuts[:-1][np.diff(cuts) == 2]  # by far the most
        alike = (sketches[twos] == sketches[twos + 1]).sum(axis=1) >= least * SET_COORDINATES
        pairs = set(zip(ids[twos[alike]].tolist(), ids[twos[alike] + 1].tolist(), strict=True))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - x < 3:
                continue
            forest, here = _Forest(y - x), sketches[x:y]
            for i in range(y - x - 1):
                if (forest.root == forest.root[0]).all():
                    break
                for j in _likely(here, i, least):
                    if forest.root[i] != forest.root[j]:
                        forest.join(i, j)
                        pairs.add((int(ids[x + i]), int(ids[x + j])))
        return _links(sorted(pairs))

    return run


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    sizes = [len(s) for s in (*x, *y)]
    values, number, counts = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = counts > 1  # what one set alone has is in no intersection
    row, number = row[often[number]], (np.cumsum(often) - 1)[number[often[number]]]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(x), len(y)))
    step = max(1, TILE_NUMBERS // len(sizes))
    for at in range(0, int(often.sum()), step):
        a, b = np.searchsorted(number, [at, at + step])
        block = np.zeros((len(sizes), step), dtype=np.float32)
        block[row[a:b], number[a:b] - at] = 1
        out += block[: len(x)] @ block[len(x) :].T  # below 2**24, so exact
    return out


def _tiles(sizes: list[int]) -> list[tuple[int, int]]:
    """Cuts of a list of sets of TILE sets and TILE_ELEMENTS elements at most, or of one larger set."""
    cuts, begin, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin == TILE or held + size > TILE_ELEMENTS):
            cuts.append((begin, i))
            begin, held = i, 0
        held += size
    return [*cuts, (begin, len(sizes))]


def _connect(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a group of sets, as few as connect what is linked; none between two of side 1 or of side 2."""
    forest, found = _Forest(len(sets)), []
    tiles = _tiles([len(s) for s in sets])
    for t, (a, b) in enumerate(tiles):
        for c, d in tiles[t:]:
            root = forest.root
            if (root[a:b] == root[a]).all() and (root[c:d] == root[a]).all():
                continue
            common = _common(sets[a:b], sets[c:d])
            x, y = (np.array([len(s) for s in sets[p:q]]) for p, q in ((a, b), (c, d)))
            linked = 100 * common >= percent * (x[:, None] + y - common)
            linked &= (sides[a:b, None] != sides[c:d]) | (sides[c:d] == 0)
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                others = np.flatnonzero(linked[i]) + c
                for j in others[forest.root[others] != forest.root[a + i]].tolist():
                    if forest.root[a + i] != forest.root[j]:
                        forest.join(a + i, j)
                        found.append((a + i, j))
    return found


def _confirm(percent: int):
    """Links of each group that the full sets confirm."""

    def run(table: pa.Table) -> pa.Table:
        ids, sides = table.column("id").to_numpy(), table.column("side").to_numpy()
        group = table.column("group").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("shingles")]
        members: dict[str, list[int]] = {}
        for i in np.lexsort((sides, ids)).tolist():
            members.setdefault(group[i], []).append(i)
        pairs = set()
        for own in members.values():
            for i, j in _connect([sets[i] for i in own], sides[own], percent):
                pairs.add((int(ids[own[i]]), int(ids[own[j]])))
        return _links(sorted(pairs))

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                shingles, bounds = _sets(data[offsets[a] : offsets[b]], own, size)
                columns = {c: batch.column(c).slice(a, b - a) for c in ("id", "cluster", "blocks")}
                columns["n"] = pa.array(np.diff(bounds).astype(np.int64))
                cuts = zip(bounds[:-1], bounds[1:], strict=True)
                columns["shingles"] = pa.array([shingles[x:y].tobytes() for x, y in cuts], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _candidates(classes: DataFrame, percent: int, settle: Settle) -> DataFrame:
    """Links between classes that meet in a node and may be similar."""
    sketches = classes.select("id", "sketch")
    first = F.lit(SET_COORDINATES) * F.col("node").bitwiseAND(3) + 1
    own = F.substring("sketch", first.cast("int"), F.lit(SET_COORDINATES)).alias("sketch")

    def sketched(rows: DataFrame) -> DataFrame:
        return rows.join(sketches, "id").select("node", "id", "size", own)

    members = classes.select("id", F.explode("nodes").alias("node"))
    found = []
    for _ in range(LEVELS):
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = settle(members.join(settle(sizes, "node-sizes"), "node").select("node", "id", "size"), "nodes")
        small = F.col("size") <= SMALL_NODE
        rows = sized.agg(F.count(F.when(small, 1)).alias("small"), F.count(F.when(~small, 1)).alias("large")).first()
        if rows["small"]:
            tasks = storage.task_count(classes, rows["small"], *TASK_ROWS)
            dealt = sketched(sized.filter(small)).withColumn("task", F.pmod(F.xxhash64("node"), F.lit(tasks)))
            found.append(dealt.drop("size").groupBy("task").applyInArrow(_compare_nodes(percent), _LINK))
        if not rows["large"]:
            break
        large = settle(sketched(sized.filter(~small)), "large")
        dense = settle(_dense(large), "dense")
        found.append(_stars(large.join(dense, "node"), settle))
        members = large.join(dense, "node", "left_anti").mapInArrow(_branch(percent), _NODE)
    else:
        found.append(_stars(large, settle))
    return reduce(DataFrame.union, found, classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))


def _dense(large: DataFrame) -> DataFrame:
    """Nodes whose documents agree in many places, from the counts of a few coordinates' tokens.

    Each document is counted for one of them, so a coordinate is seen in a share of the documents.
    """
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PROBES)).cast("int")
    token = F.substring("sketch", F.col("c") * (SET_COORDINATES // PROBES) + 1, F.lit(1))
    counts = large.withColumn("c", place).groupBy("node", "c", token.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    squares = counts.groupBy("node", "c").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("s"))
    return squares.groupBy("node").agg(F.avg("s").alias("s")).filter(F.col("s") >= DENSE).select("node")


def _stars(members: DataFrame, settle: Settle) -> DataFrame:
    """Links of each node's documents to its smallest."""
    lows = settle(members.groupBy("node").agg(F.min("id").alias("a")), "lows")
    return members.join(lows, "node").select("a", F.col("id").alias("b"))


def _confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Links within groups: (group, id, side, n, shingles) -> (a, b)."""
    elements = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = storage.task_count(sets, elements, *TASK_ELEMENTS)
    dealt = sets.withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(_confirm(percent), _LINK)


def _each(count: str) -> Column:
    """One row for each number below a column's value."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def _grouped(rows: DataFrame, side: int, *names: str) -> DataFrame:
    group = F.concat_ws("/", *names).alias("group")
    return rows.select(group, "id", F.lit(side).alias("side"), "n", "shingles")


def _large_clusters(sets: DataFrame, percent: int, block: int, settle: Settle) -> DataFrame:
    """Links of clusters that have several blocks.

    Each block is compared in itself and with its cluster's pivots. What then is not
    connected with the cluster's largest part is compared with all blocks, in parts of a
    block's size; two documents that both are in the largest part need no comparison.
    """
    own = sets.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    lot = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(PIVOTS)).alias("lot")
    chosen = sets.groupBy("cluster", lot).agg(F.min("id").alias("id")).select("cluster", "id")
    pivots = settle(sets.join(settle(chosen, "chosen"), ["cluster", "id"]), "pivots")
    copies = pivots.withColumn("block", _each("blocks"))
    blocks = _grouped(own, 0, "cluster", "block").unionByName(_grouped(copies, 0, "cluster", "block"))
    links = settle(_confirmed(blocks, percent), "block-links")

    roots = components(links, settle).withColumnRenamed("node", "id")
    names = settle(sets.select("cluster", "id", "blocks"), "names")
    placed = names.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    counts = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c"))
    mains = settle(counts.groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("main")), "mains")
    apart = placed.join(mains, "cluster").filter("root <> main").select("cluster", "id")
    apart = settle(apart, "apart")
    parts = settle(apart.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), "parts")
    others = sets.join(apart.distinct(), ["cluster", "id"]).join(parts, "cluster")
    others = others.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
    others = others.withColumn("block", _each("blocks"))
    against = own.join(parts, "cluster").withColumn("part", _each("parts"))
    pairs = _grouped(against, 1, "cluster", "block", "part").unionByName(
        _grouped(others, 2, "cluster", "block", "part")
    )
    return links.union(settle(_confirmed(pairs, percent), "apart-links"))


def _roots(rows: DataFrame, profiles: DataFrame, percent: int, words: int, block: int, settle: Settle) -> DataFrame:
    """The smallest id that each linked id can reach: (node, root)."""
    # Equal sets are one class, known by its smallest id.
    full = profiles.filter("n > 0 AND id IS NOT NULL")
    kept = [F.first(c).alias(c) for c in ("n", "sketch", "nodes")]
    classes = settle(full.groupBy("k", "h").agg(F.min("id").alias("id"), *kept), "classes")
    # Rows of a class hang on its id; so a document with several texts ties their classes.
    texts = full.select("id", "k", "h").join(classes.select(F.col("id").alias("class"), "k", "h"), ["k", "h"])
    ties = texts.filter("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"))

    clusters = components(_candidates(classes, percent, settle), settle)
    members = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())
    clustered = members.select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    sized = clustered.join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id")
    sizes = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("n") / BLOCK_ELEMENTS)).alias("blocks")
    sizes = settle(sizes.select("cluster", blocks), "cluster-sizes")
    kinds = "id long, cluster long, blocks long, n long, shingles binary"
    sets = rows.join(clustered.join(sizes, "cluster"), "id").mapInArrow(_full_sets(words), kinds).filter("n > 0")
    sets = settle(sets, "sets")
    links = _confirmed(_grouped(sets.filter("blocks = 1"), 0, "cluster"), percent)
    if not sizes.filter("blocks > 1").isEmpty():
        links = links.union(_large_clusters(sets.filter("blocks > 1"), percent, block, settle))
    return components(links.union(ties))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    words: int = 5,
    trees: int = TREES,
    block: int = BLOCK,
) -> DataFrame:
    """Groups of documents linked by equal shares of their word shingles.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. A document's set holds its
    distinct shingles of ``words`` words; with fewer words, the whole sequence. Two documents are
    linked if ``100 * intersection >= percent * union``. Returns ``id, n_shingles,
    component_id`` (smallest id reachable, itself included) and ``kept`` (the id is
    that one). A document without words (null or empty text) is linked with nothing. Rows
    that repeat an id are one document and stay together. A row without id is compared with
    nothing and kept; its component is null. ``percent`` must be 80 or more, for which the
    trees suffice.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    profiles = storage.settle(
        rows.mapInArrow(
            _profile(words, trees, percent), "id long, n long, k long, h long, sketch binary, nodes array<long>"
        ),
        "profiles",
    )
    with storage.scratch(docs.sparkSession) as settle:
        roots = _roots(rows, profiles, percent, words, block, settle)
    named = profiles.join(roots.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id"))
    return named.select(
        "id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Per document: the size of its set, its group's smallest document, and whether it is that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
