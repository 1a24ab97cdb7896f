"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become arrays of word hashes. Every k-gram gets a hash and the least of
every w consecutive k-gram hashes is kept (winnowing). With k + w - 1 = the
window length, any shared window has the same kept fingerprint at the same place
on both sides. Shared fingerprints align a document with an item, the alignment
is extended to both sides word by word, and runs as long as a window are hits.

Items shorter than a window are one window of their own length: they are found
by the hash of that many words, for the (fewer than ten) lengths that occur.

The documents are read in one pass that joins their fingerprints to the
benchmark's. The benchmark is cut into blocks of a bounded number of
fingerprints, each small enough to broadcast; a benchmark of several blocks
takes several passes, so nothing depends on its size but time. No document
fingerprint is shuffled: only found spans are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import carried
from affinity.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not a word character: ASCII other than digits and letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark fingerprints per broadcast block (rows of a few longs, some 10 MB).
BLOCK_ROWS = 200_000
_SPANS = "array<struct<from:int,to:int>>"


def words_of(text: Column) -> Column:
    """A-Z lower-cased words; null and empty texts have none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def doubled(df: DataFrame, column: str, n: int, combine) -> DataFrame:
    """Replace ``column`` by the combination of every n consecutive elements.

    Each step combines an array with itself moved by at most the length covered
    so far, about log2 n projections in all.
    """
    size = 1
    a = F.col(column)
    while size < n:
        step = min(size, n - size)
        keep = F.greatest(F.size(a) - step, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(a, F.lit(1), keep), F.slice(a, F.lit(step + 1), keep), combine))
        size += step
    return df


def with_grams(df: DataFrame, hashes: str, out: str, n: int) -> DataFrame:
    return doubled(df.withColumn(out, F.col(hashes)), out, n, lambda x, y: F.xxhash64(x, y))


def with_minima(df: DataFrame, grams: str, out: str, w: int) -> DataFrame:
    return doubled(df.withColumn(out, F.col(grams)), out, w, lambda x, y: F.least(x, y))


def _winnowed(df: DataFrame, hashes: str, k: int, w: int, keep: list[str]) -> DataFrame:
    """One row per window of w k-grams: ``keep``, _g (all k-gram hashes), _m (all minima), _i, _f (this window's)."""
    df = with_minima(with_grams(df, hashes, "_g", k), "_g", "_m", w)
    # the outer form: no filter on the array's size is derived and pushed through the projections that build it
    return df.select(*keep, "_g", "_m", F.posexplode_outer("_m").alias("_i", "_f")).filter("_f IS NOT NULL")


def _placed(df: DataFrame, keep: list[str], w: int) -> DataFrame:
    """The place _p of each kept k-gram, once for a run of windows that keep the same one."""
    i, f = F.col("_i"), F.col("_f")
    seen = (i > 0) & (F.get("_m", i - 1) == f) & (F.get("_g", i - 1) != f)
    return (df.filter(~seen)
            .select(*keep, "_f", (i + F.array_position(F.slice("_g", i + 1, F.lit(w)), f).cast("int") - 1).alias("_p")))


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading elements two arrays of equal length share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x == y), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs.cast("int") - 1)


def _extended(aligned: DataFrame, window: int) -> DataFrame:
    """Extend aligned k-grams (_h at _p, _ih at _ip) to maximal equal runs; keep runs of a whole window."""
    h, ih, p, ip = F.col("_h"), F.col("_ih"), F.col("_p"), F.col("_ip")
    back = F.least(p, ip)
    ahead = F.least(F.size(h) - p, F.size(ih) - ip)
    left = _agreeing(F.reverse(F.slice(h, p - back + 1, back)), F.reverse(F.slice(ih, ip - back + 1, back)))
    right = _agreeing(F.slice(h, p + 1, ahead), F.slice(ih, ip + 1, ahead))
    return (aligned.withColumns({"_from": p - left, "_to": p + right})
            .filter(F.col("_to") - F.col("_from") >= window))


def merged_spans(spans: Column) -> Column:
    """Union of sorted [from, to) spans as disjoint spans."""
    def step(state, s):
        joined = F.struct(state["last"]["from"].alias("from"), F.greatest(state["last"]["to"], s["to"]).alias("to"))
        grow = s["from"] <= state["last"]["to"]
        return F.struct(F.when(grow, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"]))).alias("done"),
                        F.when(grow, joined).otherwise(s).alias("last"))

    first = F.struct(F.array().cast(_SPANS).alias("done"), F.element_at(spans, 1).alias("last"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, lambda s: F.concat(s["done"], F.array(s["last"]))))


def _same(a: str, b: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


def _text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 6, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: id, n_words, hit (merged [from, to) word spans), n_hit, items (sorted item ids as strings).

    A document word is hit if it lies in an occurrence of a window of
    consecutive item words. Words are compared by 64-bit hashes, ten at a time.
    Null and empty texts have no words and no hits; items without words match
    nothing; repeated items count under each of their ids; repeated document
    rows repeat their row; either table may be empty.
    """
    judged = _judged(docs, items, window, k, id_col, text_col, item_col, item_text_col, block_rows)
    return judged.select(F.col("_id").alias(id_col), "n_words", "hit", "n_hit", "items")


_KEY = ["_id", "_k1", "_k2"]  # equal id and text: equal result, however often the row occurs


def _found(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 6, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The documents as (_id, _k1, _k2, _w), the items as (_item, _text, _ih), and the hits (_id, _k1, _k2, _text,
    _from, _to), stored; None where no item has a word."""
    w, key = window - k + 1, _KEY
    spread = lambda a: F.transform(a, lambda x: F.xxhash64(x))
    named = stage(items.select(F.col(item_col).cast("string").alias("_item"), words_of(F.col(item_text_col)).alias("_w"))
                  .filter(F.size("_w") > 0)
                  .select("_item", F.sha2(F.array_join("_w", " "), 256).alias("_text"), spread(F.col("_w")).alias("_ih")), "items")
    texts = named.groupBy("_text").agg(F.first("_ih").alias("_ih"))
    prints = _winnowed(texts.filter(F.size("_ih") >= window), "_ih", k, w, ["_text", "_ih"])
    prints = stage(_placed(prints, ["_text", "_ih"], w).withColumnRenamed("_p", "_ip"), "item_prints")
    short = stage(texts.filter(F.size("_ih") < window), "short_items")
    lengths = sorted(r[0] for r in short.select(F.size("_ih")).distinct().collect())  # at most window - 1 values
    one_gram = lambda n: (with_grams(short.filter(F.size("_ih") == n), "_ih", "_g", n)
                          .select("_text", F.get("_g", F.lit(0)).alias("_f")))

    text = F.coalesce("_t", F.lit(""))
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).select(
        "_id", *[c.alias(n) for c, n in zip(_text_keys(text), key[1:])], words_of(text).alias("_w"))
    hashed = read.select(*key, spread(F.col("_w")).alias("_h"))
    found = []
    in_block = lambda df, b, n: df.filter(F.pmod(F.xxhash64("_text"), F.lit(n)) == b)
    if n_prints := prints.count():
        blocks = -(-n_prints // block_rows)
        for b in range(blocks):
            doc = _winnowed(hashed, "_h", k, w, [*key, "_h"])
            block = in_block(prints, b, blocks)
            near = doc.join(F.broadcast(block.select("_f").distinct()), "_f", "left_semi")
            pairs = _placed(near, [*key, "_h"], w).join(F.broadcast(block), "_f")
            found.append(_extended(pairs, window).select(*key, "_text", "_from", "_to"))
    if lengths:
        blocks = -(-short.count() // block_rows)
        for b in range(blocks):
            for n in lengths:
                doc = with_grams(hashed, "_h", "_g", n).select(*key, F.posexplode_outer("_g").alias("_from", "_f"))
                found.append(doc.join(F.broadcast(in_block(one_gram(n), b, blocks)), "_f")
                             .select(*key, "_text", "_from", (F.col("_from") + n).alias("_to")))
    return read, named, stage(reduce(DataFrame.unionByName, found).distinct(), "hit_spans") if found else None


def _judged(docs: DataFrame, items: DataFrame, *settings, **more) -> DataFrame:
    """The columns of ``decontaminate`` with the id as _id, and the text's _k1, _k2."""
    key = _KEY
    read, named, spans = _found(docs, items, *settings, **more)
    out = read.select(*key, F.size("_w").cast("long").alias("n_words"))
    none = F.array().cast(_SPANS)
    if spans is None:
        return out.select(*key, "n_words", none.alias("hit"), F.lit(0).cast("long").alias("n_hit"),
                          F.array().cast("array<string>").alias("items"))
    covered = (spans.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(F.col("_from").alias("from"), F.col("_to").alias("to")))).alias("hit"))
               .withColumn("hit", merged_spans(F.col("hit"))))
    listed = (spans.select(*key, "_text").distinct().join(named.select("_text", "_item"), "_text")
              .groupBy(*key).agg(F.array_sort(F.collect_set("_item")).alias("items")))
    result = (covered.alias("c").join(listed.alias("n"), _same("c", "n", key))
              .select(*[F.col(f"c.{c}") for c in key], "hit", "items"))
    hit = F.coalesce("r.hit", none)
    return (out.alias("d").join(result.alias("r"), _same("d", "r", key), "left")
            .select(*[F.col(f"d.{c}") for c in key], "d.n_words", hit.alias("hit"),
                    F.aggregate(hit, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"]).alias("n_hit"),
                    F.coalesce("r.items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False, **settings) -> DataFrame:
    """The documents without a hit, columns as given (whatever their names); where rows share an id, a hit in one drops
    them all, unless ``by_text``: then rows are judged by id and text.

    The distinct hit documents are counted; up to BLOCK_ROWS of them (an id and two longs each) are sent to the
    documents, more are met by a shuffle."""
    _, _, spans = _found(docs, items, id_col=id_col, text_col=text_col, **settings)
    if spans is None:
        return docs
    hit = stage(spans.select(*[F.col(c).alias(f"_hit{c}") for c in (_KEY if by_text else _KEY[:1])]).distinct(), "hit_documents")
    if hit.count() <= BLOCK_ROWS:
        hit = F.broadcast(hit)
    k1, k2 = _text_keys(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    own = docs.select(carried(docs), docs[f"`{id_col}`"].alias("_id"), k1.alias("_k1"), k2.alias("_k2"))
    same = F.col("_id").eqNullSafe(F.col("_hit_id"))
    if by_text:
        same &= (F.col("_k1") == F.col("_hit_k1")) & (F.col("_k2") == F.col("_hit_k2"))
    return own.join(hit, same, "left_anti").select("_row.*")
