"""Exact Jaccard join of word 5-gram sets with a token-group matrix.

1. Documents with equal sets are one node. A fixed-size sketch counts the tokens
   of all documents; frequent tokens come last in the common order of tokens.
2. Similar nodes are grouped: nodes that share minimum hashes have a pivot of
   theirs as their home, and a home's nodes are dealt into groups of bounded
   size. Nodes that share several with a pivot are verified against it, which gives first components.
3. The token-group matrix holds for each group the union of its members' prefix
   tokens. A query node meets the groups that share a prefix token with it and
   have a member of another component, which loses no link; the number of
   shared tokens bounds the overlap with any member.
4. A group that the bound leaves is brought together with its queries: the overlap
   with the group's whole token union is bounded once more, and only then is the
   group opened and each member's overlap counted exactly. One link to each other
   component goes out.

Links within a component that step 2 has found cannot change the components, so
they are not looked for again, and no list of all pairs of a group ever exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import broadcast_if, discard, lean, materialize, shuffle_partitions, slices, unused
from spanloom.llm.components import Forest, connected_components

WORDS = 5
HASHES = 8
#: Equal minimum hashes that make a pivot worth verifying; a heuristic for groups only.
AGREE = 3
#: A group of similar nodes has at most about so many nodes, or so many tokens where that is more nodes.
GROUP_SIZE = 64
GROUP_TOKENS = 1 << 17
#: Hashes of longer words (in bytes) are not kept.
LONG_WORD = 64
#: Texts, and sets, that are Python objects at a time.
GROUP_TEXTS = 512
GROUP_SETS = 256
SKETCH_BITS = 20
SLICES = 64
#: Above so many ids, texts are found by a shuffle join instead of a broadcast.
BROADCAST_IDS = 1_000_000
#: A group with more queries is brought together with them in so many tasks.
QUERIES_A_TASK = 4096
#: Copies of a component's row where there are too many to broadcast.
SALTS = 32
NO_ID = -(2**63)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ROLL
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of five words of a text; hashes of up to ``most`` words are kept."""

    def __init__(self, words: int = WORDS, most: int = 100_000):
        self.words, self.most, self.known = words, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII blanks only
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            ids = [known[w] for w in words]
        except KeyError:
            new = {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(known)}
            ids = [known[w] if w in known else new[w] for w in words]
            if len(known) < self.most:  # the first ones met stay: they are the frequent ones
                known.update(kv for kv in new.items() if len(kv[0]) <= LONG_WORD)
        w = np.array(ids, np.uint64)
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h = h * _ROLL + w[j : len(w) - k + 1 + j]
        return np.unique(_mix(h))


def _node(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _signature(tokens: np.ndarray) -> np.ndarray:
    return np.array([((tokens * s) ^ (tokens >> np.uint64(31))).min() for s in _SEEDS]).astype(np.int64)


def _needed(x, y, percent: int):
    """Smallest overlap of sets of ``x`` and ``y`` elements with 100 * overlap >= percent * union."""
    return -((-(x + y) * percent) // (100 + percent))


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _least_both(n: Column, low: Column, high: Column, percent: int) -> Column:
    """Fewest prefix tokens that a set of ``n`` tokens shares with a similar one of any size from ``low`` to ``high``.

    Up to ``n`` the bound does not fall with the size. Above, it follows a falling line
    within the two ceilings' rounding: once the line has fallen by one, no smaller
    size has a smaller bound. So the smallest is at ``low`` or at one of the last sizes.
    """

    def at(size: Column) -> Column:
        need = F.ceil((n + size) * percent / (100.0 + percent) - 1e-9)
        beyond = F.ceil(F.greatest(n, size) * percent / 100.0 - 1e-9) - 1
        return need - beyond

    last = -(-100 * (100 + percent) // percent**2)
    if last > 32:  # rounding moves the bound by less than two, so it is never more than one above
        return F.least(at(low), at(high)) - 1
    return F.least(at(low), *[at(F.greatest(low, high - k)) for k in range(last)])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))


def _profile(docs: DataFrame) -> DataFrame:
    """Of ``doc_id, text, key``. Rows of kind 0: id, key, set size, node and signature of each document; of kind 1: slices of each task's token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "doc_id", "key", "n", "node", "signature", "counts"]
        for batch in slices(batches, GROUP_TEXTS):
            n, node, signature = [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py())
                n.append(len(tokens))
                node.append(_node(tokens) if len(tokens) else None)
                signature.append(_signature(tokens) if len(tokens) else None)
                np.add.at(counts, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * rows, pa.int32()), batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(node, pa.int64()),
                 pa.array(signature, pa.list_(pa.int64())), pa.nulls(rows, pa.binary())], names)
        step = len(counts) // SLICES
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * SLICES, pa.int32()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.nulls(SLICES, pa.int64()),
                 pa.nulls(SLICES, pa.list_(pa.int64())), pa.array([counts[i * step : (i + 1) * step].astype("<u4").tobytes() for i in range(SLICES)])], names)

    return docs.mapInArrow(lean(run), "kind int, doc_id bigint, key bigint, n int, node bigint, signature array<bigint>, counts binary")


def _sketch(profile: DataFrame) -> np.ndarray:
    """The summed counts: a vector of fixed size, whatever the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums.keys(), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()])], ["n", "counts"])

    rows = profile.where("kind = 1").select("n", "counts").repartition(SLICES, "n").mapInArrow(lean(run), "n int, counts binary").collect()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for r in rows:
        out[r["n"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, tokens`` (sorted 64-bit hashes) of the ``wanted`` nodes (``node, rep``), from the texts of their representatives."""
    n = wanted.count()
    wanted = broadcast_if(wanted, n, BROADCAST_IDS)
    rows = docs.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(wanted, "rep").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for part in slices(batches, GROUP_TEXTS):
            nodes, tokens = [], []
            for node, text in zip(*(c.to_pylist() for c in part.columns)):
                found = shingles(text)
                if len(found) and _node(found) == node:  # else another row of the same id
                    nodes.append(node)
                    tokens.append(found.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])

    found = rows.mapInArrow(lean(run), "node bigint, tokens binary")
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


class _Group:
    """Members' sets of one group: their token union and which members hold each token."""

    def __init__(self, members: list[tuple[int, int, bytes]], percent: int):
        self.percent, self.nodes = percent, np.array([m for m, _, _ in members], np.int64)
        self.roots = np.array([r for _, r, _ in members], np.int64)
        sets = [np.frombuffer(t, np.uint64) for _, _, t in members]
        self.sizes = np.array([len(s) for s in sets])
        union = np.concatenate(sets)
        order = np.argsort(union, kind="stable")
        self.union, self.holder = union[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def links(self, root: int, tokens: np.ndarray) -> np.ndarray:
        """Places of members that are similar enough to a query's set: one of each component but the query's own."""
        low, high = np.searchsorted(self.union, tokens, "left"), np.searchsorted(self.union, tokens, "right")
        held = high - low
        if np.count_nonzero(held) * 100 < self.percent * len(tokens):
            return np.empty(0, np.int64)  # no member can hold enough: the group stays closed
        places = np.repeat(low - np.concatenate(([0], np.cumsum(held)[:-1])), held) + np.arange(held.sum())
        overlap = np.bincount(self.holder[places], minlength=len(self.nodes))
        near = np.flatnonzero((overlap * 100 >= self.percent * (self.sizes + len(tokens) - overlap)) & (self.roots != root))
        return near[np.unique(self.roots[near], return_index=True)[1]]


def _open(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (``u, v``) between queries (``node, root, grp``) and the members (``node, root, grp``) of their groups.

    Members come first in each (group, part) and are bounded by ``GROUP_SIZE`` and ``GROUP_TOKENS``;
    queries are then streamed. A group with very many queries is dealt over several
    parts. A link goes out only where the part's earlier links do not lead from
    component to component already, so there are fewer links than rows.
    """
    parts = queries.groupBy("grp").agg((F.floor(F.count("*") / QUERIES_A_TASK) + 1).cast("int").alias("parts"))
    right = members.join(parts, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "root")
    left = queries.join(parts, "grp").select("grp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "node", "root")
    rows = (
        right.unionByName(left)
        .join(sets, "node")
        .repartition(n, "grp", "part")
        .sortWithinPartitions("grp", "part", "kind")
        .select("grp", "part", "kind", "node", "root", "tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, group, forest = None, [], None, Forest()
        for batch in slices(batches, GROUP_SETS):
            u, v = [], []
            for g, part, kind, node, root, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, part) != key:
                    key, members, group, forest = (g, part), [], None, Forest()
                if kind == 0:
                    members.append((node, root, tokens))
                    continue
                if not members:
                    continue
                group = group or _Group(members, percent)
                for k in group.links(root, np.frombuffer(tokens, np.uint64)).tolist():
                    if forest.find(root) != forest.find(group.roots[k].item()):  # else earlier links lead there
                        forest.join(root, group.roots[k].item())
                        u.append(node)
                        v.append(group.nodes[k].item())
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(lean(run), "u bigint, v bigint")


def _prefixes(docs: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """``token, node, n``: the first tokens of each set in the common order, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 4 * 2 ** SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), shared.value
        for part in slices(batches, GROUP_TEXTS):
            found, nodes, sizes = [], [], []
            for text in part.column(0).to_pylist():
                tokens = shingles(text)
                if len(tokens):
                    many = counts[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
                    order = np.minimum(many, (1 << 24) - 1) << np.uint64(40) | tokens >> np.uint64(24)
                    k = _prefix_length(len(tokens), percent)
                    found.append(tokens[np.argsort(order, kind="stable")[:k]])
                    nodes.append(_node(tokens))
                    sizes.append(len(tokens))
            if found:
                k = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), k)), pa.array(np.repeat(np.array(sizes, np.int32), k))],
                    ["token", "node", "n"],
                )

    return docs.select("text").mapInArrow(lean(run), "token bigint, node bigint, n int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node, the distinct ones of tokens that more than one node has; one row is held."""
    held = None  # the last row, which may be alone with its token
    for batch in batches:
        token, node, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(token):
            continue
        alone = False
        if held is not None:
            token, node, n = np.concatenate(([held[0]], token)), np.concatenate(([held[1]], node)), np.concatenate(([held[2]], n))
            alone = held[3]
        # A row goes out if a row beside it has its token and another node. Repeats of a row fall away.
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n = token[fresh], node[fresh], n[fresh]
        same = token[1:] == token[:-1]
        out = np.zeros(len(token), bool)
        out[1:] |= same
        out[:-1] |= same
        if alone:  # the held row has gone out already
            out[0] = False
        sent = bool(out[-1]) or (alone and len(token) == 1)
        held = (token[-1], node[-1], n[-1], sent)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(node[out]), pa.array(n[out], pa.int32())], ["token", "node", "n"])


def link_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of bytes other than the ASCII blanks, A-Z lower-cased; a text's set has its
    distinct runs of five words, or the whole sequence where it has fewer. Two
    texts link when 100 * overlap >= ``percent`` * union; ``component_id`` is the
    smallest id that links lead to, its own included. No link is lost (sets are of
    64-bit hashes).

    A null or blank text has an empty set and is linked with nothing, not
    even its like. A null id is larger than all others. Rows that repeat an id are texts
    of their own. An empty table gives no rows; other columns are not read. An id that is no number is an error.
    """
    return _link(_slim(docs, id_col, text_col), percent).drop("key")


def _link(docs: DataFrame, percent: int) -> DataFrame:
    """``link_components`` of ``doc_id, text, key``, with the ``key`` of each row."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    profile = materialize(_profile(docs), "profile")
    slim = profile.where("kind = 0")
    # Bounds that the sizes of the written tables go by.
    rows, tokens_in_all = slim.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets_rows = tokens_in_all // 50  # as many tokens are about as large as a row of the other tables
    nodes = materialize(
        slim.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "nodes",
        rows,
    )
    reps = nodes.select("node", F.coalesce("low", F.lit(NO_ID)).alias("rep"))

    # Groups: stars around pivots.
    keyed = nodes.select("node", F.posexplode("signature").alias("j", "h"))
    pivots = keyed.groupBy("j", "h").agg(F.min("node").alias("grp"), F.count("*").alias("many")).where("many > 1")
    near = keyed.join(pivots, ["j", "h"])
    stars = materialize(
        near.where("node != grp").groupBy("node", "grp").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE).drop("agree"),
        "stars",
        HASHES * rows,
    )
    centers = stars.select(F.col("grp").alias("node"), F.col("grp").alias("root"), "grp").distinct()
    wanted = stars.select("node").unionByName(centers.select("node")).distinct()
    star_sets = materialize(_sets(docs, wanted.join(reps, "node")), "star-sets", sets_rows)
    first_links = materialize(_open(stars.withColumn("root", F.col("node")), centers, star_sets, percent, n), "links", HASHES * rows)
    grouped = connected_components(first_links, rows=HASHES * rows)

    # The token-group matrix: groups of bounded size with one home.
    homes = stars.groupBy("node").agg(F.min("grp").alias("home")).unionByName(centers.select("node", F.col("node").alias("home")))
    homes = homes.groupBy("node").agg(F.min("home").alias("home"))
    # Nodes of no star are at home with those that share their most frequent minimum hash.
    others = near.groupBy("node").agg(F.max(F.struct("many", "grp")).alias("b")).select("node", F.col("b.grp").alias("other"))
    homes = others.join(homes, "node", "full").select("node", F.coalesce("home", "other").alias("home")).join(nodes.select("node", "n"), "node")
    deals = F.least(F.count("*") / GROUP_SIZE, F.sum("n") / GROUP_TOKENS)
    many = homes.groupBy("home").agg(F.count("*").alias("many"), (F.floor(deals) + 1).alias("deals"))
    members = homes.join(many, "home").join(grouped, "node", "left").select(
        "node",
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("many") == 1, F.col("node")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("deals")))).alias("grp"),
    )
    members = materialize(members, "members", rows)
    prefixes = _prefixes(docs, _sketch(profile), percent).repartition(n, "token").sortWithinPartitions("token", "node")
    tokens = materialize(prefixes.mapInArrow(lean(_shared), "token bigint, node bigint, n int"), "tokens", tokens_in_all // 4)
    placed = tokens.join(broadcast_if(members, members.count(), BROADCAST_IDS), "node", "left").select(
        "token", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("grp", "node").alias("own")
    )
    matrix = placed.groupBy("token", F.col("own").alias("grp")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("least_root"), F.max("root").alias("last_root")
    )
    elsewhere = (F.col("root") != F.col("least_root")) | (F.col("root") != F.col("last_root"))
    sizes = (F.col("low") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("high") * 100)
    met = (
        placed.join(matrix, "token")
        .where((F.col("own") <= F.col("grp")) & elsewhere & sizes)
        .groupBy("node", "root", "n", "grp")
        .agg(F.count("*").alias("both"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    # Sizes of members that could link with the query.
    low = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100)).cast("long")
    high = F.least(F.col("high"), F.floor(F.col("n") * 100 / percent)).cast("long")
    asked = met.where(low <= high).where(F.col("both") >= _least_both(F.col("n"), low, high, percent)).select("node", "root", "grp")
    asked = materialize(asked, "asked", HASHES * rows)
    met_groups = asked.select("grp").distinct()
    opened = met_groups.join(members, "grp", "left").select(
        F.coalesce("node", "grp").alias("node"), F.coalesce("root", "node", "grp").alias("root"), "grp"
    )
    wanted = asked.select("node").unionByName(opened.select("node")).distinct()
    query_sets = materialize(_sets(docs, wanted.join(reps, "node")), "query-sets", sets_rows)
    more_links = _open(asked, opened, query_sets, percent, n)
    components = materialize(connected_components(first_links.unionByName(more_links), rows=HASHES * rows), "components", rows)
    discard(stars, star_sets, first_links, members, tokens, asked, query_sets)

    # A large component's root is a hot key: its one row is broadcast, or copied for each salt.
    ids = materialize(components.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id")), "component-ids", rows)
    if (many := ids.count()) <= BROADCAST_IDS:
        named = components.join(broadcast_if(ids, many, BROADCAST_IDS), "root")
    else:
        salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = components.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"])
    found = nodes.select("node", "low").join(named.select("node", "component_id"), "node", "left").select(
        "node", F.coalesce("component_id", "low").alias("component_id")
    )
    return slim.select("doc_id", "key", "n", "node").join(found, "node", "left").select(
        "doc_id",
        "key",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_smallest(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component; all columns stay as they are.

    Of rows that repeat both id and text one stays; of rows that repeat only the
    id, those whose own component has that id. Documents without words, and
    rows without id in a component without any id, stay. An empty table gives no rows.
    """
    slim = _slim(docs, id_col, text_col)
    own, text = unused(docs, "own_id", "text_key")
    kept = (
        _link(slim, percent)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias(own), F.col("key").alias(text))
        .distinct()
    )
    keyed = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text: F.xxhash64(F.col(text_col))})
    return keyed.join(kept, [own, text], "left_semi").dropDuplicates([own, text]).select(*docs.columns)
