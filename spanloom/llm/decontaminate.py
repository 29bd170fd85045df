"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark window is a sequence of words that must occur whole, so its
overlap threshold is its full size and one prefix token is necessary: the rarest of
its three-word shingles, by the shingles' counts over all documents. Documents
are exploded to shingles and joined with those prefix tokens only; the window's
place is then bounded by the token's position and the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import ascii_lower, broadcast_if, materialize, unused

#: What stands between words, which are runs of ASCII letters, digits and anything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Above so many windows the joins shuffle instead of broadcasting.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """A text's words. Splitting is linear; ``regexp_extract_all`` copies the whole text for each match."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _shingle(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), at + j) for j in range(k)])


def _windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``window`` (array of words), ``len`` and the sorted ``items`` that hold it."""
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
        .where((F.size("words") > 0) & F.col("item").isNotNull())
        .select(
            "item",
            "words",
            F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))).alias("at"),
        )
        .select("item", F.slice("words", F.col("at"), size).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("len", F.size("window"))
    )


def _tokens(windows: DataFrame, k: int) -> DataFrame:
    """A row for each shingle of ``k`` words of each window."""
    fits = F.col("len") == k if k < 3 else F.col("len") >= k
    return windows.where(fits).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("offset")
    ).withColumn("token", _shingle("window", F.col("offset"), k))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_text"), words_of(F.col(text_col)).alias("words"))


def _positions(docs: DataFrame, id_col: str, text_col: str, ks: list[int]) -> DataFrame:
    """A row for each word position (and shingle size), one at least for each document.

    ``words`` is the document's array by reference: it must not be shuffled with the rows.
    """
    each = _words(docs, id_col, text_col).select("k_id", "k_text", "words", F.posexplode_outer("words").alias("pos", "word"))
    tokens = [_shingle("words", F.col("pos"), k) for k in ks]
    token = tokens[0] if len(ks) == 1 else F.explode(F.array(*tokens))
    return each.select("k_id", "k_text", "words", "pos", token.alias("token"))


def _near(docs: DataFrame, id_col: str, text_col: str, ks: list[int], prefixes: DataFrame) -> DataFrame:
    """Positions with the windows whose prefix token stands there, each document's first one in any case."""
    return _positions(docs, id_col, text_col, ks).join(F.broadcast(prefixes), "token", "left")


def _near_shuffled(docs: DataFrame, id_col: str, text_col: str, ks: list[int], prefixes: DataFrame) -> DataFrame:
    """The same for windows that are too many to broadcast.

    Only ids, positions and tokens are shuffled with the prefixes. What meets is gathered by
    document, which has few such places, and joined with the document's words once.
    """
    at = _positions(docs, id_col, text_col, ks).where("pos is not null").select("k_id", "k_text", "pos", "token")
    met = at.join(prefixes, "token").select(F.col("k_id").alias("m_id"), F.col("k_text").alias("m_text"), F.struct("pos", "token", "offset", "window", "len", "items").alias("m"))
    gathered = met.groupBy("m_id", "m_text").agg(F.collect_set("m").alias("ms"))
    words = _words(docs, id_col, text_col)
    joined = words.join(gathered, words["k_id"].eqNullSafe(gathered["m_id"]) & words["k_text"].eqNullSafe(gathered["m_text"]), "left")
    return joined.select("k_id", "k_text", "words", F.explode_outer("ms").alias("m")).select("k_id", "k_text", "words", "m.*")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``k_id, k_text, n_words, n_hit, items`` for every distinct (id, text) of ``docs``.

    ``items`` is the array of ids, as sorted strings, of items with a window in
    the text. ``n_hit`` counts the words inside any occurrence of a window.
    """
    bound = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0] // 2 + benchmark.count()
    windows = materialize(_windows(benchmark, item_id_col, item_text_col, size), "windows", bound)
    lens = [r["k"] for r in windows.select(F.least(F.lit(3), "len").alias("k")).distinct().collect()]
    ks = sorted(lens) or [3]
    n_windows = windows.count()
    tokens = _tokens(windows, ks[0])
    for k in ks[1:]:
        tokens = tokens.unionByName(_tokens(windows, k))
    tokens = materialize(tokens, "window-tokens", size * n_windows)
    distinct = tokens.select("token").distinct()
    counts = (
        _positions(docs, id_col, text_col, ks)
        .select("token")
        .join(broadcast_if(distinct, n_windows, BROADCAST_WINDOWS), "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        tokens.join(counts, "token", "left")
        .groupBy("window", "len", "items")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("prefix"))
    )
    # A window with a token that no document has cannot occur.
    prefixes = materialize(
        rarest.where("prefix.n > 0").select("prefix.token", "prefix.offset", "window", "len", "items"), "prefixes", n_windows
    )
    first = F.col("pos") - F.col("offset")
    occurs = F.when(
        (first >= 0) & (first + F.col("len") <= F.size("words")),
        F.slice("words", first + 1, F.col("len")) == F.col("window"),
    ).otherwise(False)
    near = _near if n_windows <= BROADCAST_WINDOWS else _near_shuffled
    found = (
        near(docs, id_col, text_col, ks, prefixes)
        .select("k_id", "k_text", F.size("words").alias("n_words"), "pos", "len", "items", first.alias("first"), occurs.alias("hit"))
        .where(F.coalesce("hit", F.lit(False)) | F.col("pos").isNull() | (F.col("pos") == 0))
        .select(
            "k_id",
            "k_text",
            "n_words",
            F.when(F.col("hit"), F.col("first")).alias("first"),
            F.when(F.col("hit"), F.col("first") + F.col("len")).alias("end"),
            F.when(F.col("hit"), F.col("items")).alias("items"),
        )
        .distinct()
    )
    before = (
        Window.partitionBy("k_id", "k_text").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    )
    fresh = F.col("end") - F.greatest("first", F.coalesce(F.max("end").over(before), F.lit(0)))
    return (
        found.repartition("k_id", "k_text")
        .withColumn("fresh", F.greatest(F.lit(0), fresh))
        .groupBy("k_id", "k_text")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct (id, text): ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased. A null or empty text has no words and is clean; a
    null id is an id like any other; rows that repeat both id and text give one
    row, rows that share only the id one row each. Items without words, or with
    a null id, are ignored; repeated items count once. An item of fewer than
    ``size`` words is one window. Empty tables give no rows, or clean rows.
    """
    hits = find_hits(docs, benchmark, size, id_col, text_col)
    return hits.select(
        F.col("k_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose share of hit words is at most ``max_share``; all columns stay as they are.

    Rows without text or without words stay, repeated rows stay or go together, a null id
    is an id like any other. Without items all rows stay; an empty table gives none.
    """
    k_id, k_text = unused(docs, "hit_id", "hit_text")
    bad = (
        find_hits(docs, benchmark, size, id_col, text_col)
        .where(F.col("n_hit") > F.col("n_words") * F.lit(float(max_share)))
        .select(F.col("k_id").alias(k_id), F.col("k_text").alias(k_text))
    )
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.xxhash64(F.col(text_col)) == F.col(k_text)), "left_anti")
