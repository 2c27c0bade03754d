"""Phrases whose words belong together, mined by dynamic itemset counting."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidegate.llm.common import slices, text_or_empty
from tidegate.session import materialized, remove, work_path

LEAST = 30
MOST_WORDS = 4
FIRST = 2_000
SCALE = 2_000_000
COVERED = 80  # percent of a phrase's occurrences in a longer one that make it a part of that
SHARDS = 4
WINDOW_WORDS = 300_000
HELD_COUNTS = 500_000  # counts a task holds before it gives them out
BUCKET_BYTES = 64_000_000  # of text, for each bucket of counts
FILTER_BITS = 16, 28  # the admission filter has 2^16 to 2^28 bits, by the bytes of text
RANK_BUCKETS = 64

BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
# Word hashes: the sum of a random number per letter times a power per place. What the hashes decide is checked by spelling.
LETTERS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
PLACE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """A run of words: their letters and where each begins in them, their pieces and languages, and hashes by language
    and spelling. Phrases may begin at the first ``begin`` of them."""

    letters: np.ndarray
    places: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    hashes: np.ndarray
    begin: int

    def spelled(self) -> pa.DictionaryArray:
        return pa.StringArray.from_buffers(len(self.lang), pa.py_buffer(self.places), pa.py_buffer(self.letters)).dictionary_encode()

    def phrases(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1 to ``most``: whether a phrase of so many words begins at each word, and its hash."""
        hashes, n = self.hashes, len(self.lang)
        yield np.ones(n, bool), hashes
        for length in range(2, most + 1):
            longer, whole, last = np.zeros(n, np.uint64), np.zeros(n, bool), max(0, n - length + 1)
            longer[:last] = mixed(hashes[:last] * PLACE + self.hashes[n - last :])
            whole[:last] = self.piece[:last] == self.piece[n - last :]
            hashes = longer
            yield whole, hashes


def word_hashes(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    lengths = np.diff(places)
    powers = np.full(int(lengths.max()), PLACE).cumprod()
    place = np.arange(len(letters)) - np.repeat(places[:-1], lengths)
    return np.add.reduceat(LETTERS[letters] * powers[place], places[:-1])


def read_words(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[list[str], Words]]:
    """The words of a batch (lang, text), in runs of WINDOW_WORDS that share ``overlap`` words with the next run."""
    texts = pc.binary_join_element_wise(batch.column("text"), "", "\n")  # a break behind each text
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    kind = KIND[data]
    letter = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    coded = batch.column("lang").dictionary_encode()
    langs = coded.dictionary.to_pylist()
    lang_hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)
    lang = np.repeat(coded.indices.to_numpy(), np.diff(np.searchsorted(starts, offsets - offsets[0])))
    for a in range(0, len(starts), WINDOW_WORDS):
        b = min(len(starts), a + WINDOW_WORDS + overlap)
        low, high = starts[a], ends[b - 1]
        letters = np.frombuffer(data[low:high].tobytes().translate(LOWER, BLANKS + BREAKS), np.uint8)
        places = np.concatenate([[0], np.cumsum(ends[a:b] - starts[a:b])]).astype(np.int32)
        piece = np.cumsum(kind[low:high] == 2, dtype=np.int32)[starts[a:b] - low]
        own = mixed(word_hashes(letters, places) + lang_hashes[lang[a:b]])
        yield langs, Words(letters, places, piece, lang[a:b].astype(np.int64), own, min(WINDOW_WORDS, b - a))


class Admission:
    """The phrases that have reached the threshold, as one bit of a bit field each, which is broadcast. The field's
    size is fixed for a run. A phrase may share its bit with others; that admits more phrases, never fewer."""

    def __init__(self, bits: int, field: np.ndarray | None = None):
        self.bits = bits
        self.field = np.zeros(max(1, 2**bits // 64), np.uint64) if field is None else field

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.field[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def bits_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of the field that the bits of sorted hashes lie in, and these bits."""
        at = hashes >> np.uint64(64 - self.bits)
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        return word, np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at

    def grown(self, rows: pa.Table) -> Admission:
        """With the bits of rows (h, c), packed words of the field and their bits."""
        field = self.field.copy()
        for word, bits in zip(*(rows.column(c).to_pylist() for c in ("h", "c"))):
            field[np.frombuffer(word, np.uint64)] |= np.frombuffer(bits, np.uint64)
        return Admission(self.bits, field)


def active(words: Words, admission: Admission, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to ``most``: where phrases begin both of whose subphrases, all but the last and all but the first
    word, are admitted; and all hashes. Single words always are."""
    held = None
    for whole, hashes in words.phrases(most):
        here = whole.copy()
        here[words.begin :] = False
        if held is not None:
            here &= held
            here[:-1] &= held[1:]
            here[-1:] = False
        yield here, hashes
        held = admission.holds(hashes) & whole


PACKED = "bucket int, since int, h binary, c binary"  # sorted hashes of a range of hashes, and their counts
FIELD = -1  # in place of ``since``: words of the admission field and their bits


def packed(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
    columns += [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (2, 3)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "since", "h", "c"])


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, sorted, with the sums of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def counted_step(shard: DataFrame, admission: Admission, before: Admission | None, most: int, step: int, buckets: int) -> DataFrame:
    """Packed counts, by hash, of the phrases in a shard that are active now and were not (``before``, one cycle ago)
    when the shard was last scanned. A bucket is a range of hashes."""
    sent = shard.sparkSession.sparkContext.broadcast((admission, before))
    borders = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def emit(held) -> pa.RecordBatch:
        h, c = summed(*held)
        cuts = [0, *np.searchsorted(h, borders), len(h)]
        return packed([(i, step, h[a:b], c[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, earlier = sent.value
        held, many = ([], []), 0
        for batch in slices(batches, "text"):
            for _, words in read_words(batch, most - 1):
                done = active(words, earlier, most) if earlier else ((False, None) for _ in range(most))
                new = [hashes[here & ~np.asarray(was)] for (here, hashes), (was, _) in zip(active(words, now, most), done)]
                h, c = np.unique(np.concatenate(new), return_counts=True)
                held[0].append(h)
                held[1].append(c)
                many += len(h)
                if many > HELD_COUNTS:
                    yield emit(held)
                    held, many = ([], []), 0
        if many:
            yield emit(held)

    return shard.select("lang", "text").mapInArrow(count, PACKED)


def merged_step(counts: DataFrame, admission: Admission, least: int, gone: int) -> DataFrame:
    """The packed counts of each bucket added up. Phrases that have reached the threshold become bits of the field;
    others that were first counted after step ``gone`` stay."""

    def merge(rows: pa.Table) -> pa.Table:
        since = rows.column("since").to_pylist()
        blobs = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)) for h, c in zip(*(rows.column(x).to_pylist() for x in ("h", "c")))]
        h, c = summed(*zip(*blobs))
        first = np.full(len(h), np.iinfo(np.int32).max)
        for step, (own, _) in zip(since, blobs):
            at = np.searchsorted(h, own)
            first[at] = np.minimum(first[at], step)
        bucket = rows.column("bucket")[0].as_py()
        out = [(bucket, FIELD, *admission.bits_of(h[c >= least]))]
        for step in sorted({x for x in since if x > gone}):
            stays = (first == step) & (c < least)
            out.append((bucket, step, h[stays], c[stays]))
        return pa.Table.from_batches([packed(out)])

    return counts.groupBy("bucket").applyInArrow(merge, PACKED)


def named_counts(shards: DataFrame, admission: Admission, most: int) -> DataFrame:
    """(lang, size, phrase, c) of the admitted phrases, by their spelling; size 0 counts all words of a language."""
    sent = shards.sparkSession.sparkContext.broadcast(admission)
    names = ["lang", "size", "phrase", "c"]

    def batch_of(lang, size: int, phrase, counts) -> pa.RecordBatch:
        columns = [pa.array(lang, pa.string()), pa.array(np.full(len(counts), size, np.int32)), phrase, pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admission = sent.value
        for batch in slices(batches, "text"):
            for langs, words in read_words(batch, most - 1):
                spelled, coded = pa.array(langs, pa.string()), words.spelled()
                known, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                all_words = np.bincount(words.lang[: words.begin], minlength=len(langs))
                yield batch_of(spelled, 0, pa.array([""] * len(langs)), all_words)
                for size, (here, hashes) in enumerate(active(words, admission, most), 1):
                    at = np.flatnonzero(here)
                    at = at[admission.holds(hashes[at])]
                    # The number of a phrase: that of its beginning, times the number of words, plus the next word's.
                    number = words.lang[at] * len(known) + word[at]
                    for more in range(1, size):
                        number = np.unique(number, return_inverse=True)[1] * len(known) + word[at + more]
                    _, first, counts = np.unique(number, return_index=True, return_counts=True)
                    at = at[first]
                    parts = [known.take(pa.array(word[at + m])) for m in range(size)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                    yield batch_of(spelled.take(pa.array(words.lang[at])), size, phrase, counts)

    return shards.select("lang", "text").mapInArrow(count, "lang string, size int, phrase string, c bigint")


def frequent_phrases(documents: DataFrame, least: int, most: int, shards: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, size, phrase, f): phrases of 1 to ``most`` words that occur ``least`` times or more, and with size 0 the
    number of all words of each language.

    Texts are dealt into shards, which are scanned in a cycle. A phrase becomes active when both its subphrases have
    reached the threshold, wherever in the cycle that is, and is counted in each shard once: lengths are interleaved.
    Counts are kept by 64-bit hash, packed in buckets of hashes; a phrase below the threshold is let go when its cycle
    is complete. As two phrases may share a hash, a last scan counts the phrases found by their spelling.
    """
    spark = documents.sparkSession
    path, seen = work_path(spark, "shards"), Observation()
    rows = documents.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    rows = rows.observe(seen, F.sum(F.octet_length("text")).alias("bytes"))
    rows.withColumn("shard", F.monotonically_increasing_id() % shards).write.partitionBy("shard").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)

    fewest, largest = FILTER_BITS
    bits = min(largest, max(fewest, int(seen.get["bytes"] or 0).bit_length() - 4))
    # The field after each step; a step that changes nothing since the shard's last scan has nothing to count, and
    # neither have all later ones. Phrases of n words are complete after n cycles at most.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (seen.get["bytes"] or 0) // BUCKET_BYTES, 1)
    admitted, live, step = [Admission(bits)], None, 0
    while step < shards or step < shards * most and (admitted[step].field != admitted[step - shards].field).any():
        earlier = admitted[step - shards] if step >= shards else None
        counts = counted_step(texts.filter(F.col("shard") == step % shards), admitted[step], earlier, most, step, buckets)
        counts = counts if live is None else counts.unionByName(live)
        held = work_path(spark, "counts")
        merged_step(counts, admitted[step], least, step - shards + 1).write.parquet(held)
        kept = spark.read.schema(PACKED).parquet(held)
        admitted.append(admitted[step].grown(kept.filter(F.col("since") == FIELD).select("h", "c").toArrow()))
        if live is not None:
            remove(spark, live_path)
        live, live_path = kept.filter(F.col("since") != FIELD), held
        if step >= shards:
            admitted[step - shards] = None
        step += 1
    found = named_counts(texts, admitted[step], most).groupBy("lang", "size", "phrase").agg(F.sum("c").alias("f"))
    found = materialized(found.filter((F.col("f") >= least) | (F.col("size") == 0)), "phrases")
    for done in (live_path, path):
        remove(spark, done)
    return found


def spoken(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    documents: DataFrame, least: int = LEAST, words: int = MOST_WORDS, first: int = FIRST, shards: int = SHARDS,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language by falling score and count.

    Texts are split into pieces at ``. , ; : ! ?`` and line ends and pieces into words at blanks; A-Z count in lower
    case. Candidates are phrases of 2 to ``words`` words that occur a >= ``least`` times within pieces. Cut in two, a
    candidate scores floor(2,000,000 a / (l + r)), l and r being the counts of its parts; the cut that scores lowest
    counts, of equal ones the first. Candidates 80 percent of whose occurrences lie in one longer candidate go.

    Driver and broadcasts hold the bit fields of admitted phrases (32 MB at most, whatever the input), no phrases.
    Counts are summed per task before they are shuffled, so a phrase that is everywhere is one row per task and
    million words; a language's ranks come from the first rows of each of its buckets.

    A null text is empty, a null language is ``und``. Repeated rows count as often as they are there. A row's text is
    read whole; a task holds about six bytes per byte of a very long one. Other columns are not read; an empty table
    gives an empty one.
    """
    found = frequent_phrases(documents, least, words, shards, text_col, lang_col)
    counts = found.filter(F.col("size") > 0).select("lang", "phrase", "f")
    totals = found.filter(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    candidates = found.filter(F.col("size") > 1).select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))

    w, size = F.col("w"), F.col("size")
    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", spoken(w, F.lit(1), F.col("k")).alias("left"), spoken(w, F.col("k") + 1, size - F.col("k")).alias("right"))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    whole = "decimal(20,0)"
    score = F.expr(f"(CAST(a AS {whole}) * {SCALE}) div (CAST(l AS {whole}) + CAST(r AS {whole}))")
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.*")

    lengths = F.sequence(F.lit(2), size - 1)
    parts = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: spoken(w, at, m))))
    longer = candidates.filter(size > 2).select("lang", F.explode(parts).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    alone = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("most") * 100 < F.col("a") * COVERED, F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    ahead = alone.withColumn("place", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).filter(F.col("place") <= first)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
