"""Collocations: phrases that stand together more often than their parts, from counting quotient filters."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.llm import quotient
from bandwise.llm.common import ascii_lower, cut, placed, stored, text_key

LEAST = 100
WORDS = 5
TOP = 2000
#: Most bytes a dictionary of frequent words takes in a worker; a larger one is joined to the texts instead.
DICTIONARY_BYTES = 128 << 20
#: Words counted in a task before the counts leave it, and what their characters may take.
HELD_WORDS, HELD_BYTES = 500_000, 128 << 20
#: Entries of the filters in a task before they leave it, and expected entries of a shard of all tasks' filters.
HELD_ENTRIES, SHARD_ENTRIES = 2_000_000, 1 << 21
#: Texts are read, and their n-grams taken, in pieces of so many bytes and words.
SLICE, CHUNK = 1 << 20, 1 << 18
#: Bits of the filter of frequent pairs: 16 a pair, within these bounds. It only saves work, so a full one is right too.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SALTS = 256

# ASCII letters in lower case; characters that end a piece become line breaks.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands between pieces; no word can be a full stop.
BREAK = b"."


def _tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """Words, with `BREAK` between pieces, of bounded slices that together are the text."""
    plain = (text or b"").translate(TABLE)
    at = 0
    while at < len(plain):
        end = at + SLICE
        if end < len(plain):
            found = [x for x in (plain.find(c, end) for c in (b" ", b"\t", b"\n")) if x >= 0]
            end = min(found, default=len(plain))
        yield plain[at:end].replace(b"\n", b" . ").split()
        at = end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    read = 0

    def drained() -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            counter.pop(BREAK, None)
            words = list(counter)
            for first in range(0, len(words), 50_000):
                part = words[first : first + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([counter[w] for w in part], pa.int64())], names=["_lang", "_word", "_f"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for tokens in _tokens(text.as_py()):
                counts[lang].update(tokens)
                read += sum(map(len, tokens))
            if read > HELD_BYTES or sum(map(len, counts.values())) > HELD_WORDS:
                yield from drained()
                read = 0
    yield from drained()


def pair_bits(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair of ids in a language."""
    own = np.uint64(int.from_bytes(lang.encode()[:64], "little") % ((1 << 61) - 1))
    mixed = (first.astype(np.uint64) * quotient.MULTIPLIERS[0]) ^ (second.astype(np.uint64) + own) * quotient.MULTIPLIERS[1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= quotient.MULTIPLIERS[2]
    return mixed ^ (mixed >> np.uint64(30))


class _Filters:
    """Sorted filters of a task, by language and length; merged when they are many."""

    def __init__(self, lengths: list[int], bits: int, shard_bits: int, pairs: np.ndarray | None):
        self.lengths, self.bits, self.shard_bits, self.pairs = lengths, bits, shard_bits, pairs
        self.runs: dict[tuple[str, int], list] = defaultdict(list)
        self.entries = 0

    def _known(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Where a pair starts that may be frequent."""
        good = (ids[:-1] > 0) & (ids[1:] > 0)
        if self.pairs is not None:
            at = np.flatnonzero(good)
            hashed = pair_bits(lang, ids[at], ids[at + 1])
            mask = np.uint64(8 * len(self.pairs) - 1)
            for turn in range(2):
                place = hashed >> np.uint64(32 * turn) & mask
                good[at] &= self.pairs[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1
        return good

    def add(self, lang: str, ids: np.ndarray) -> None:
        """All n-grams of a sequence of ids, in which 0 stands for a break or a rare word."""
        longest = max(self.lengths)
        for first in range(0, len(ids), CHUNK):
            part = ids[first : first + CHUNK + longest - 1]
            own = min(CHUNK, len(ids) - first)
            known = self._known(lang, part)
            good = np.ones(len(part), dtype=bool)
            for words in range(2, longest + 1):
                # From each place on, words - 1 pairs in a row.
                good = good[: len(part) - words + 1] & known[words - 2 : len(part) - 1]
                if words not in self.lengths:
                    continue
                at = np.flatnonzero(good[:own])
                if len(at):
                    sizes = quotient.widths(words, self.bits)
                    key = quotient.permute(quotient.pack([part[at + i] for i in range(words)], self.bits), words, self.bits)
                    run = quotient.counted(key, None, sizes)
                    self.runs[lang, words].append(run)
                    self.entries += len(run[1])

    def full(self) -> bool:
        if self.entries > HELD_ENTRIES:
            for (lang, words), runs in self.runs.items():
                if len(runs) > 1:
                    runs[:] = [quotient.merged(runs, quotient.widths(words, self.bits))]
            self.entries = sum(len(run[1]) for runs in self.runs.values() for run in runs)
        return self.entries > HELD_ENTRIES // 2

    def drained(self) -> Iterator[pa.RecordBatch]:
        """A row for each language, length and shard: keys that agree in their first bits."""
        for (lang, words), runs in self.runs.items():
            sizes = quotient.widths(words, self.bits)
            parts, counts = quotient.merged(runs, sizes)
            shard_bits = min(self.shard_bits, sizes[0])
            shards = (parts[0] >> np.uint64(sizes[0] - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(counts), dtype=np.int64)
            numbers, starts = np.unique(shards, return_index=True)
            filters = []
            for low, high in zip(starts, np.append(starts[1:], len(counts))):
                filters.append(quotient.encode([p[low:high] for p in parts], counts[low:high], sizes, shard_bits))
            n = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array([words] * n, pa.int32()), pa.array(numbers, pa.int64()), pa.array(filters, pa.binary())], names=["_lang", "_words", "_shard", "_filter"]
            )
        self.runs.clear()
        self.entries = 0


def _ngrams(dictionary, lengths: list[int], bits: int, shard_bits: int, pairs):
    """Map function: languages and texts (and, without a dictionary, their own words and ids) to shards of filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if dictionary is None else dictionary.value
        filters = _Filters(lengths, bits, shard_bits, None if pairs is None else np.frombuffer(pairs.value, dtype=np.uint8))
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        waiting = 0

        def counted() -> None:
            for lang, ids in held.items():
                filters.add(lang, np.concatenate(ids))
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                lang = langs[i]
                if known is not None:
                    own = known.get(lang, {})
                else:
                    own = dict(zip(batch.column(2)[i].as_py() or [], batch.column(3)[i].as_py() or []))
                get = own.get
                for tokens in _tokens(text.as_py()):
                    held[lang].append(np.fromiter(map(get, tokens, repeat(0)), np.int64, len(tokens)))
                    waiting += len(tokens)
                held[lang].append(np.zeros(1, dtype=np.int64))
                if waiting > CHUNK:
                    counted()
                    waiting = 0
                    if filters.full():
                        yield from filters.drained()
        counted()
        yield from filters.drained()

    return run


def _merge(bits: int, shard_bits: int, least: int):
    """Group function: one shard of all tasks' filters, merged; keys that are frequent, as ids."""

    def run(key: tuple, shards: pa.Table) -> pa.Table:
        lang, words, shard = (k.as_py() for k in key)
        sizes = quotient.widths(words, bits)
        own = min(shard_bits, sizes[0])
        parts, counts = quotient.merged([quotient.decode(f.as_py(), sizes, shard, own) for f in shards.column("_filter")], sizes)
        often = np.flatnonzero(counts >= least)
        ids = np.stack(quotient.unpack(quotient.permute([p[often] for p in parts], words, bits, undo=True), words, bits), axis=1).astype(np.int64)
        n = len(often)
        columns = {
            "_lang": pa.array([lang] * n, pa.string()),
            "_words": pa.array([words] * n, pa.int32()),
            "_ids": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), pa.array(ids.reshape(-1))),
            "_f": pa.array(counts[often], pa.int64()),
            "_pair": pa.array(pair_bits(lang, ids[:, 0], ids[:, 1]).view(np.int64)),
        }
        return pa.table(columns)

    return run


def _pair_filter(pairs: DataFrame) -> bytes:
    """Two bits for each frequent pair, gathered as words of 64 bits: 32 MB at most, however many pairs."""
    bits, wanted = LEAST_BITS, 16 * pairs.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    both = F.array(F.col("_pair").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("_pair", 32).bitwiseAND(F.lit(bits - 1)))
    places = pairs.select(F.explode(both).alias("_place"))
    gathered = places.groupBy(F.shiftright("_place", 6).cast("int").alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))
    words = np.zeros(bits // 64, dtype=np.int64)
    for at, value in gathered.toLocalIterator():
        words[at] = value
    return words.tobytes()


def _with_codes(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Texts with the frequent words in them and their ids, by joins: no task holds more than a text's own words."""
    keys = text_key(F.col("_lang"), F.col("_text"))
    keyed = texts.withColumns({"_k1": keys[0], "_k2": keys[1]})
    once = keyed.groupBy("_k1", "_k2", "_lang").agg(F.first("_text").alias("_text"))
    words = F.split(ascii_lower(F.col("_text").cast("string")), r"[\x20\x09.,;:!?\x0A-\x0D]+")
    each = once.select("_k1", "_k2", "_lang", F.explode(F.array_distinct(words)).alias("_word")).withColumn("_word", F.col("_word").cast("binary"))
    codes = each.join(vocabulary, ["_lang", "_word"]).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("_word", "_id")).alias("_codes"))
    return keyed.join(codes, ["_k1", "_k2"], "left").select("_lang", "_text", F.col("_codes._word").alias("_known"), F.col("_codes._id").alias("_known_ids"))


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, dictionary_bytes: int = DICTIONARY_BYTES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (`_lang`, `_n`), frequent words (`_lang`, `_word`, `_id`, `_f`) and phrases (`_lang`, `_words`, `_ids`, `_f`).

    Phrases of 1 to `words` words with at least `least` occurrences, in exact counts over whole texts. The parts of a
    frequent phrase are frequent, so words are counted first, then pairs of frequent words, then longer phrases made of
    pairs that may be frequent; what these steps leave out cannot reach `least`. Each task keeps sorted counting quotient
    filters and gives them away in shards of key ranges. Keys are permuted, so that shards are even whatever phrases are
    common, and a phrase in a third of all texts is one entry a task. A shard's filters are merged in one task; their
    number grows with the words, so that a shard's size doesn't.
    """
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).cast("binary").alias("_text"))
    counts = plain.mapInArrow(_count_words, "_lang string, _word binary, _f long")
    counts = stored(counts.groupBy("_lang", "_word").agg(F.sum("_f").alias("_f")), "words")
    totals = cut(counts.groupBy("_lang").agg(F.sum("_f").alias("_n")))
    vocabulary = placed(counts.filter(F.col("_f") >= least), "_lang", ["_word"]).drop("_n").withColumn("_id", F.col("_at") + 1).drop("_at")
    vocabulary = stored(vocabulary, "vocabulary")
    size = vocabulary.agg(F.max("_id"), F.count("*"), F.sum(F.octet_length("_word"))).first()
    single = vocabulary.select("_lang", F.lit(1).alias("_words"), F.array("_id").alias("_ids"), "_f")
    if not size[0] or words < 2:
        return totals, vocabulary, single
    bits = size[0].bit_length()
    largest = totals.agg(F.max("_n")).first()[0]
    shard_bits = max(0, (largest // SHARD_ENTRIES).bit_length())
    context = docs.sparkSession.sparkContext
    dictionary, texts = None, plain
    if 160 * size[1] + size[2] <= dictionary_bytes:
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for row in vocabulary.select("_lang", "_word", "_id").toLocalIterator():
            known[row[0]][bytes(row[1])] = row[2]
        dictionary = context.broadcast(dict(known))
    else:
        texts = stored(_with_codes(plain, vocabulary.select("_lang", "_word", "_id")), "coded")

    def counted(lengths: list[int], pairs) -> DataFrame:
        shards = texts.mapInArrow(_ngrams(dictionary, lengths, bits, shard_bits, pairs), "_lang string, _words int, _shard long, _filter binary")
        found = shards.groupBy("_lang", "_words", "_shard").applyInArrow(_merge(bits, shard_bits, least), "_lang string, _words int, _ids array<long>, _f long, _pair long")
        return stored(found, "phrases")

    pairs = counted([2], None)
    found = single.unionByName(pairs.drop("_pair"))
    if words > 2:
        longer = counted(list(range(3, words + 1)), context.broadcast(_pair_filter(pairs)))
        found = found.unionByName(longer.drop("_pair"))
    return totals, vocabulary, found


def _product(*factors: Column | str) -> Column:
    """Exact up to 38 digits; more raises."""
    total = F.lit(1).cast("decimal(38,0)")
    for factor in factors:
        total = total * (F.col(factor) if isinstance(factor, str) else factor).cast("decimal(38,0)")
    return total


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    words: int = WORDS,
    top: int = TOP,
    inside_percent: int = 100,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """`_lang`, `_rank`, `_phrase`, `_a`, `_l`, `_r`, `_n`, `_score`: the first `top` phrases of each language.

    Words lie between spaces and tabs in pieces that end at `.,;:!?` and line ends, in lower case (A-Z). `_a` is how often
    the phrase occurs, `_l` and `_r` its parts at the cut with the lowest score 1000 a n / (l r), rounded down; ties go to the
    shorter first part. Phrases inside a longer one that occurs at least `inside_percent` of a hundred times as often
    are left out. Order: score, then count, falling, then phrase by UTF-8 bytes.

    Null and empty texts have no words; a null language is `und`, together with texts in a language of that name.
    Repeated rows count each. Long texts are read in slices, and no phrase is lost between them. Empty tables, and those
    in which nothing occurs `least` times, give no rows. Other columns are not looked at, whatever their names.

    Products are decimals, so they are exact beyond 64 bits. Longer phrases of frequent phrases are looked at one word
    up only, as what lies between a phrase and a longer one occurs at least as often as the longer one.
    """
    totals, vocabulary, phrases = phrase_counts(docs, text, lang, least, words, dictionary_bytes)
    whole = phrases.filter("_words >= 2")
    part = phrases.select(F.col("_lang").alias("_part_lang"), F.col("_ids").alias("_part"), F.col("_f").alias("_part_f"))

    def held(df: DataFrame, column: str, name: str) -> DataFrame:
        joined = df.join(part, (F.col("_lang") == F.col("_part_lang")) & (F.col(column) == F.col("_part")))
        return joined.withColumn(name, F.col("_part_f")).drop("_part_lang", "_part", "_part_f", column)

    cuts = whole.join(totals, "_lang").withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("_words") - 1)))
    cuts = cuts.withColumns({"_left": F.slice("_ids", F.lit(1), F.col("_cut")), "_right": F.slice("_ids", F.col("_cut") + 1, F.col("_words") - F.col("_cut"))})
    cuts = held(held(cuts, "_left", "_l"), "_right", "_r")
    cuts = cuts.withColumns({"_top": _product(F.lit(1000), "_f", "_n"), "_below": _product("_l", "_r")}).withColumn("_score", F.expr("_top div _below"))
    best = cuts.groupBy("_lang", "_ids", "_words", "_f", "_n").agg(F.min(F.struct("_score", "_cut", "_l", "_r")).alias("_best"))

    inner = F.explode(F.array(F.slice("_ids", F.lit(1), F.col("_words") - 1), F.slice("_ids", F.lit(2), F.col("_words") - 1)))
    longer = whole.filter("_words >= 3").select("_lang", inner.alias("_ids"), "_f").groupBy("_lang", "_ids").agg(F.max("_f").alias("_longer"))
    kept = best.join(longer, ["_lang", "_ids"], "left").filter(F.coalesce(100 * F.col("_longer") < inside_percent * F.col("_f"), F.lit(True)))

    spelled = kept.select("_lang", "_ids", F.posexplode("_ids").alias("_place", "_id")).join(vocabulary.select("_lang", "_id", "_word"), ["_lang", "_id"])
    in_order = F.array_sort(F.collect_list(F.struct("_place", F.col("_word").cast("string").alias("word"))))
    spelled = spelled.groupBy("_lang", "_ids").agg(F.array_join(in_order.getField("word"), " ").alias("_phrase"))
    rows = kept.join(spelled, ["_lang", "_ids"])
    rows = rows.select("_lang", "_phrase", F.col("_f").alias("_a"), F.col("_best._l").alias("_l"), F.col("_best._r").alias("_r"), "_n", F.col("_best._score").alias("_score"))

    # The first of each of many parts of a language, then of those: no task sorts a whole language.
    order = [F.col("_score").desc(), F.col("_a").desc(), F.col("_phrase")]
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_phrase"), F.lit(SALTS)))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= top)
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*order))).filter(F.col("_rank") <= top)
    return rows.select("_lang", F.col("_rank").cast("long"), "_phrase", "_a", "_l", "_r", "_n", "_score")
