"""Spelling variants: words one edit apart, found on sorted lists by dynamic programming.

Two words one edit apart share their first half or their last half unchanged. So
every word is listed by its first half and, spelt backwards, by its last half, and
only words of one list are compared. A list is sorted; the edit matrix of a whole
set of query words against one list word is kept row by row (three cells of a row
can be within one edit), the next list word reuses the rows of the prefix that it
shares with the last one, and words whose shared prefix is already more than one
edit from every query are skipped.

A list longer than ``block_words`` is laid out as a grid: blocks of its words
against blocks of its queries, so no task holds an unbounded list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words or queries of a list that meet in one cell.
BLOCK_WORDS = 4096
_PAIRS = "word string, n long, near string, near_n long"


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, typo: int = 97, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): letter runs of all texts, A-Z lower-cased, of enough code points and occurrences.

    Where ``typo`` divides the crc32 of `<id>:<run>` (a null id is an empty one),
    the run loses the code point at that crc32 modulo its length (0: no run does).
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.explode_outer(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("_run")).filter("_run IS NOT NULL")
    word = F.col("_run")
    if typo:
        h, size = F.crc32(F.concat("_id", F.lit(":"), "_run")), F.char_length("_run")
        at = (h % size).cast("int")
        word = F.when(h % typo == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, size))).otherwise(word)
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def listed(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, cell, back, half, asks, spelling, n): every word in the lists where its neighbours are.

    A pair of lengths (m, m) or (m, m + 1) meets in the lists of m, keyed by
    the first or the last m // 2 letters; ``spelling`` is reversed in the latter.
    ``asks`` has bit 1 for a query (length m) and bit 2 for a word of the list.
    """
    size = F.char_length("word")
    m = F.explode(F.array(size, size - 1))
    rows = (words.select("word", "n", size.alias("_size"), m.alias("_m")).filter("_m > 0")
            .select("word", "n", "_m", (F.col("_size") == F.col("_m")).alias("_asks"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back")))
    spelling = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    half = (F.col("_m") / 2).cast("int")
    # the last half of m letters is what the first half leaves
    shared = F.when(F.col("back"), F.col("_m") - half).otherwise(half)
    rows = rows.select(spelling.alias("spelling"), "n", "back", half.alias("half"), "_asks",
                       F.concat_ws("|", "back", "_m", F.substring(spelling, F.lit(1), shared)).alias("key"))
    one = F.lit(1).cast("long")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_asks").alias("_queries"))
    large = (sizes.filter(F.col("_n") > block_words)
             .select("key", F.ceil(F.col("_queries") / block_words).alias("_qs"), F.ceil(F.col("_n") / block_words).alias("_ws")))
    lone = sizes.filter((F.col("_n") < 2) | (F.col("_queries") < 1)).select("key")
    rows = (rows.join(lone, "key", "left_anti").join(large, "key", "left")
            .withColumns({"_qs": F.greatest(F.coalesce("_qs", one), one), "_ws": F.coalesce("_ws", one)}))
    every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    at = lambda c: F.pmod(F.xxhash64("spelling"), F.col(c))
    # in a list of one cell a word is in it once, with both bits
    query_cells = F.transform(every("_ws"), lambda w: F.struct((at("_qs") * F.col("_ws") + w).alias("cell"), F.lit(1).alias("asks")))
    word_cells = F.transform(every("_qs"), lambda q: F.struct((q * F.col("_ws") + at("_ws")).alias("cell"), F.lit(2).alias("asks")))
    alone = (F.col("_qs") == 1) & (F.col("_ws") == 1)
    only = lambda bits: F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(bits).alias("asks")))
    cells = (F.when(alone & F.col("_asks"), only(3)).when(alone, only(2))
             .when(F.col("_asks"), F.concat(query_cells, word_cells)).otherwise(word_cells))
    return rows.select("key", "back", "half", "spelling", "n", F.explode(cells).alias("_c")).select(
        "key", "_c.cell", "back", "half", "_c.asks", "spelling", "n")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, behind one leading and at least two trailing zeros; and the lengths."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(size.max(initial=0)) + 4), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return np.roll(out, 1, axis=1), size


def _next_row(row: np.ndarray, depth: int, letter: int, queries: np.ndarray) -> np.ndarray:
    """The edit matrix's three cells around ``depth`` from those of the row before (2 stands for more than one edit)."""
    same = queries[:, depth - 1:depth + 2] != letter  # query letters depth - 1, depth, depth + 1, counted from 1
    new = np.minimum(row + same, 2)  # along the diagonal
    new[:, :2] = np.minimum(new[:, :2], row[:, 1:] + 1)  # a letter of the list word too many
    new[:, 1] = np.minimum(new[:, 1], new[:, 0] + 1)  # a letter of the query too many
    new[:, 2] = np.minimum(new[:, 2], new[:, 1] + 1)
    return new


def near_in_list(words: list[str], queries: list[str], shared: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """For sorted distinct ``words``: (place of a word, places of the queries at exactly one edit).

    All words and queries must start with the same ``shared`` letters: their rows are known.
    """
    letters, size = _letters(words)
    asked, asked_size = _letters(queries)
    differs = letters[1:, 1:] != letters[:-1, 1:]
    common = np.concatenate([[0], np.argmax(differs, axis=1)])  # with the word before; the words are distinct
    # rows[d]: alive queries and their cells after d letters of the current word; cells of before the word are out of reach
    first = np.minimum(np.abs(np.arange(-1, 2))[None, :] + np.array([[1, 0, 0]]), 2).astype(np.int8)
    everyone, along = np.arange(len(queries)), np.array([[1, 0, 1]], np.int8)
    rows = [(everyone, np.repeat(first, len(queries), axis=0))] + [(everyone, np.repeat(along, len(queries), axis=0))] * shared
    dead = 1 << 30  # letters after which no query was left in the last word
    for i, length in enumerate(size.tolist()):
        if common[i] >= dead:
            continue
        dead = 1 << 30
        del rows[max(common[i], shared) + 1:]
        word = letters[i]
        for depth in range(len(rows), length + 1):
            alive, row = rows[-1]
            row = _next_row(row, depth, word[depth], asked[alive])
            row[asked_size[alive] < depth - 1] = 2
            left = row.min(axis=1) <= 1
            if not left.any():
                dead = depth
                break
            rows.append((alive, row) if left.all() else (alive[left], row[left]))
        else:
            alive, row = rows[length]
            end = asked_size[alive] - length + 1
            near = (end >= 0) & (end <= 2)
            near[near] = row[near, end[near]] == 1
            if near.any():
                yield i, alive[near]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan the lists, which come sorted by key, cell and spelling."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    out: list[list] = [[], [], [], []]

    def scan(rows: list[tuple]) -> None:
        asks, words = [r for r in rows if r[4] & 1], [r for r in rows if r[4] & 2]
        if not asks or not words:
            return
        back, half = rows[0][2], rows[0][3]
        turn = (lambda s: s[::-1]) if back else (lambda s: s)
        shared = len(asks[0][5]) - half if back else half
        for i, found in near_in_list([r[5] for r in words], [r[5] for r in asks], shared):
            w, wn = turn(words[i][5]), words[i][6]
            for j in found.tolist():
                q, qn = turn(asks[j][5]), asks[j][6]
                if back and q[:half] == w[:half]:
                    continue  # met by the first half
                out[0].append(q), out[1].append(qn), out[2].append(w), out[3].append(wn)
                if len(w) != len(q):  # words of equal length ask each other
                    out[0].append(w), out[1].append(wn), out[2].append(q), out[3].append(qn)

    def filled() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
        for c in out:
            c.clear()
        return batch

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (row[0] != held[0][0] or row[1] != held[0][1]):
                if len(held) > 1:
                    scan(held)
                held = []
            held.append(row)
            if len(out[0]) >= 50_000:
                yield filled()
    if len(held) > 1:
        scan(held)
    yield filled()


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): both directions of every two distinct words that differ by one inserted, deleted or replaced code point."""
    lists = listed(words, block_words)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (lists.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell", "spelling")
            .mapInArrow(_pairs, _PAIRS))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms followed to the last, by doubling the step each round."""
    links = stage(forms.select("word", F.col("form").alias("root")), "spelling_links")
    while True:
        onward = links.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        links = stage(links.join(onward, links["root"] == onward["_at"], "left")
                      .select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "spelling_links")
        if links.filter("_moved").isEmpty():
            return links.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, typo: int = 97, ratio: int = 2,
                   block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``form`` is the near word (one edit away) of greatest n, of these the least
    by code points, if its n is at least ``ratio`` times (2 or more, so that forms
    end) the word's own, else null; ``root`` is where forms lead.

    Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count each; an empty table gives no rows; other columns are
    not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms must grow")
    words = stage(word_counts(docs, least_length, least_count, typo, id_col, text_col), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    found = (near_pairs(words, block_words).groupBy("word")
             .agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"), F.first("n").alias("n"))
             .withColumn("_ok", -F.col("_best.n") >= ratio * F.col("n")))
    found = stage(found.select("word", "n_near", F.when(F.col("_ok"), F.col("_best.word")).alias("form"),
                               F.when(F.col("_ok"), -F.col("_best.n")).alias("form_n")), "spelling_forms")
    roots = _roots(found.filter("form IS NOT NULL"))
    zero = F.lit(0).cast("long")
    return (words.join(found, "word", "left").join(roots, "word", "left")
            .select("word", "n", F.coalesce("n_near", zero).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")))

