"""Benchmark decontamination by canonical templates, with a check that slots are filled consistently."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import cut

WORDS = 5
SHARE = 0.5
#: Words of a template window that must be literal, so that a run of names does not match every other. Windows with fewer
#: grow until they hold as many.
LITERAL = 3
#: Bits of the filter on window hashes: 512 for each window of the benchmark, and never more than 2 ** 26 (8 MB).
LEAST_BITS, MOST_BITS, BITS_A_WINDOW = 1 << 16, 1 << 26, 512
#: Items' windows that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 50_000
SLICE_CHARS = 1 << 20
CACHE = 300_000

# Units, in alphabetical order within each group.
UNITS = frozenset(
    "cm dm ft in inch inches kilometers km m meter meters metre metres mi mile miles mm yard yards "
    "g gram grams kg kilogram kilograms lb lbs mg ounce ounces oz pound pounds ton tons tonne tonnes "
    "day days h hour hours min minute minutes month months ms s sec second seconds week weeks year years "
    "l liter liters litre litres ml "
    "c celsius degree degrees fahrenheit k kelvin "
    "cent cents dollar dollars eur euro euros gbp percent usd $ % € £ "
    "a amp amps hz j joule joules kmh kw mph n newton newtons v volt volts w watt watts".split()
)
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,/]*[%$€£]?")
QUANTITY = re.compile(r"[+-]?\d[\d.,/]*([^\W\d_]+)")
EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
)

#: Titles, whose full stop doesn't end a run of names.
TITLES = frozenset("dr. mr. mrs. ms. prof. st.".split())

# Kinds of tokens.
PLAIN, NAME, NUM, UNIT_WORD = 0, 1, 2, 3


class _Numbers(dict):
    """Tokens by number; new ones are added when first asked for."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, token: str) -> int:
        number = self[token] = self.add(token)
        return number


class Vocabulary:
    """Tokens by number, each with the hash of its literal form, of its template form, its kind and its normal form."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids = _Numbers(self._add)
        self.forms: list[str] = []
        self.literal = np.zeros(1024, dtype=np.uint64)
        self.template = np.zeros(1024, dtype=np.uint64)
        self.kind = np.zeros(1024, dtype=np.int8)
        self.ends = np.zeros(1024, dtype=bool)

    def _add(self, token: str) -> int:
        number = len(self.forms)
        if number == len(self.kind):
            wider = (np.concatenate((x, np.zeros_like(x))) for x in (self.literal, self.template, self.kind, self.ends))
            self.literal, self.template, self.kind, self.ends = wider
        bare = token.rstrip(".,")
        letters = bare.isalpha()  # nearly all tokens, and then no pattern is needed
        if not letters:
            bare = EDGE.sub("", token) or token
        form = bare.lower()
        if form in NUMBER_WORDS or not letters and (NUMBER.fullmatch(bare) or QUANTITY.fullmatch(bare)):
            kind = NUM
        elif form in UNITS:
            kind = UNIT_WORD
        elif bare[0].isupper() and bare[1:2] != "" and not bare.isupper():
            kind = NAME
        else:
            kind = PLAIN
        own = xxhash.xxh64_intdigest(form.encode(), 1)
        self.literal[number] = own
        self.template[number] = {NAME: NAME_HASH, NUM: NUM_HASH}.get(kind, own)
        self.kind[number] = kind
        self.ends[number] = token[-1] in ".,;:!?" and token.lower() not in TITLES
        self.forms.append(form)
        return number

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.forms) > CACHE:
            self.clear()
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))


NAME_HASH, NUM_HASH, UNIT_HASH = (xxhash.xxh64_intdigest(f"<{x}>".encode(), 2) for x in ("name", "num", "unit"))
FACTORS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]


def _windows(hashes: np.ndarray, words: int) -> np.ndarray:
    count = len(hashes) - words + 1
    total = np.zeros(count, dtype=np.uint64)
    for i in range(words):
        total += hashes[i : i + count] * np.uint64(FACTORS[i])
    total ^= total >> np.uint64(31)
    return total * np.uint64(FACTORS[7])


BASE = np.uint64(0xD1342543DE82EF95)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(count: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least `count` of each; kept for the next text."""
    if len(_POWERS[0]) < count:
        for i, base in enumerate((BASE, UNBASE)):
            steps = np.full(2 * count, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def _long_windows(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of windows of any lengths, by differences of running totals."""
    power, undo = _powers(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)))
    found = (total[stop] - total[first]) * undo[first] + (stop - first).astype(np.uint64)
    found ^= found >> np.uint64(31)
    return found * np.uint64(FACTORS[7])


@dataclass
class _Slice:
    """Some tokens of a text, also as elements: a token each, but a run of names is one."""

    token: int  # number of the first token within the text
    element: int
    final: bool
    ids: np.ndarray
    kind: np.ndarray
    starts: np.ndarray  # of each element, and the number of tokens at the end
    unit: np.ndarray  # of each element
    slot: np.ndarray


def _slices(text: str, words: int, vocabulary: Vocabulary) -> Iterator[_Slice]:
    """Slices that overlap in so many elements that each window lies within one of them."""
    at, token, element, kept = 0, 0, 0, []
    while at < len(text):
        end = min(len(text), at + SLICE_CHARS)
        while end < len(text) and not text[end].isspace():
            end += 1
        tokens = kept + text[at:end].split()
        at = end
        if not tokens:
            continue
        ids = vocabulary(tokens)
        kind = vocabulary.kind[ids]
        name = kind == NAME
        opens = np.ones(len(ids), dtype=bool)
        opens[1:] = ~(name[1:] & name[:-1] & ~vocabulary.ends[ids[:-1]])
        starts = np.flatnonzero(opens)
        unit = kind == UNIT_WORD  # a unit is one behind a number only
        unit[1:] &= kind[:-1] == NUM
        unit[0] = False
        unit = unit[starts]
        slot = unit | (kind[starts] == NAME) | (kind[starts] == NUM)
        yield _Slice(token, element, at >= len(text), ids, kind, np.append(starts, len(ids)), unit, slot)
        if at >= len(text):
            return
        # Twice what a window needs, from an element that doesn't depend on the one before.
        literal = np.cumsum(~slot[::-1])[::-1]
        enough = np.flatnonzero((literal >= 2 * LITERAL) & (np.arange(len(starts))[::-1] >= 2 * words) & (kind[starts] != UNIT_WORD))
        first = int(enough[-1]) if len(enough) else 0
        kept = tokens[starts[first] :]
        token, element = token + int(starts[first]), element + first


def _template_windows(part: _Slice, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element, end and hash of each window of `words` elements, grown until it holds `LITERAL` literal ones.

    Windows grow forwards from their first element and backwards from their last one, so elements at both ends of a text
    are in some window.
    """
    count = len(part.slot)
    before = np.concatenate(([0], np.cumsum(~part.slot)))  # literal elements before each
    plain = np.flatnonzero(~part.slot)
    first = np.arange(count - words + 1)
    stop = first + words
    short = before[stop] - before[first] < LITERAL
    whole = first[~short]
    # Forwards: behind the last of the literal elements needed.
    ahead = first[short]
    ahead = ahead[before[ahead] + LITERAL <= len(plain)]
    ahead_stop = plain[before[ahead] + LITERAL - 1] + 1
    # Backwards: from the first of them.
    back_stop = stop[short]
    back_stop = back_stop[before[back_stop] >= LITERAL]
    back = plain[before[back_stop] - LITERAL]
    grown, grown_stop = np.concatenate((ahead, back)), np.concatenate((ahead_stop, back_stop))
    found = _windows(hashes, words)[whole]
    if len(grown):
        found = np.concatenate((found, _long_windows(hashes, grown, grown_stop)))
    return np.concatenate((whole, grown)), np.concatenate((whole + words, grown_stop)), found


def text_windows(text: str, words: int, vocabulary: Vocabulary, wanted=None, whole: bool = False) -> Iterator[tuple]:
    """(level, hash, position, form, slots, first, last) of every window that passes `wanted`.

    Level 0 has all words literally, in lower case and without punctuation at their ends. Level 1 has placeholders for
    numbers, runs of names and units, and windows that grow until they hold `LITERAL` other words; its positions count a
    run of names once. Slots list kind and value of the placeholders. `first` to `last` are the places of the literal
    windows whose words this window covers. With `whole`, names at both ends of the text have null for a slot: where the
    text stands within another, such a run may take in the name beside it.
    """
    for part in _slices(text, words, vocabulary):
        ids, starts = part.ids, part.starts
        if len(ids) >= words:
            found = _windows(vocabulary.literal[ids], words)
            good = np.arange(len(found)) if wanted is None else np.flatnonzero(wanted(found))
            for at in good.tolist():
                place = part.token + at
                yield 0, int(found[at].astype(np.int64)), place, " ".join([vocabulary.forms[i] for i in ids[at : at + words]]), [], place, place
        if len(part.slot) < words:
            continue
        own = vocabulary.template[ids[starts[:-1]]]
        own[part.unit] = UNIT_HASH
        first, stop, found = _template_windows(part, own, words)
        good = np.ones(len(found), dtype=bool) if wanted is None else wanted(found)
        if not part.final and part.slot[-1] and part.kind[starts[-2]] == NAME:
            good = good & (stop < len(part.slot))  # the run of names may go on
        for k in np.flatnonzero(good).tolist():
            forms, slots = [], []
            for j in range(first[k], stop[k]):
                form = " ".join([vocabulary.forms[i] for i in ids[starts[j] : starts[j + 1]]])
                if part.slot[j]:
                    name = "unit" if part.unit[j] else "name" if part.kind[starts[j]] == NAME else "num"
                    edge = not part.token + j or part.final and j == len(part.slot) - 1
                    slots.append(None if whole and edge and name == "name" else f"{name} {form}")
                    form = f"<{name}>"
                forms.append(form)
            low, high = part.token + int(starts[first[k]]), part.token + int(starts[stop[k]]) - words
            # All places within a run of names are those of its first window.
            high = max(high, part.token + int(starts[first[k] + 1]) - 1)
            yield 1, int(found[k].astype(np.int64)), part.element + int(first[k]), " ".join(forms), slots, low, high


def _window_rows(words: int, filter_bits=None, whole: bool = False):
    """Map function: ids and texts to rows of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        wanted = None
        if filter_bits is not None:
            bits = np.frombuffer(filter_bits.value, dtype=np.uint8)
            mask = np.uint64(len(bits) * 8 - 1)

            def wanted(hashes: np.ndarray) -> np.ndarray:
                at = hashes & mask
                return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1

        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("_text")):
                for row in text_windows(text.as_py() or "", words, vocabulary, wanted, whole):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield _batch(batch, at, rows)
                        at, rows = [], []
            if rows:
                yield _batch(batch, at, rows)

    return run


def _batch(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    level, hashed, position, form, slots, first, last = zip(*rows)
    columns = [
        *[batch.column(c).take(pa.array(at)) for c in ("_id", "_body")],
        pa.array(level, pa.int32()),
        pa.array(hashed, pa.int64()),
        pa.array(position, pa.int64()),
        pa.array(form, pa.string()),
        pa.array(slots, pa.list_(pa.string())),
        pa.array(first, pa.int64()),
        pa.array(last, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["_id", "_body", "_level", "_hash", "_at", "_form", "_slots", "_low", "_high"])


def _windows_of(df: DataFrame, key: str, text: str, words: int, filter_bits=None, whole: bool = False) -> DataFrame:
    slim = df.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_body"), F.col(text).alias("_text"))
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, _body long, _level int, _hash long, _at long, _form string, _slots array<string>, _low long, _high long"
    return slim.mapInArrow(_window_rows(words, filter_bits, whole), schema)


def _filter_bits(windows: DataFrame) -> bytearray:
    """A bit for each hash, gathered as words of 64 bits: at most 8 MB, whatever the size of the benchmark."""
    bits = LEAST_BITS
    wanted = BITS_A_WINDOW * windows.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = F.col("_hash").bitwiseAND(F.lit(bits - 1))
    set_bits = windows.select(F.shiftright(at, 6).cast("int").alias("_word"), F.expr("shiftleft(1L, cast(_hash & 63 as int))").alias("_bit"))
    words = np.zeros(bits // 64, dtype=np.int64)
    for word, value in set_bits.groupBy("_word").agg(F.bit_or("_bit")).toLocalIterator():
        words[word] = value
    return bytearray(words.tobytes())


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    share: float = SHARE,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: `_id`, `_body`, `_item`, `_share`, `_literal_share`.

    Windows of `words` words of both sides are canonicalised and joined on their hash, then compared as text. Matches
    of one document and item at one distance between their positions are an alignment. Its slots are consistent if each
    value in the item stands for one value in the document and the other way round. `_share` is the share of the item's
    windows whose words consistent alignments cover, literally or as templates; pairs of at least `share` are returned.

    Items of fewer than `words` words match nothing; null and empty texts have no windows. Each text
    is judged on its own, whatever other texts share its id or have none: `_body` is its xxhash64. Repeated rows are
    found once; items of one text are each found. Pairs without an item id are not returned. Empty tables give no rows. Other columns are not looked at.

    A filter of bounded size, made of the benchmark's hashes, is all that tasks need to drop nearly every window before
    it leaves them; what it lets through is checked exactly. The benchmark's windows are broadcast up to
    `BROADCAST_WINDOWS` and joined by a shuffle beyond, where adaptive execution splits a passage that many share.
    """
    context = docs.sparkSession.sparkContext
    items = cut(_windows_of(benchmark.filter(F.col(item_id).isNotNull()), item_id, item_text, words, whole=True))
    items = items.select(F.col("_id").alias("_item"), "_level", "_hash", F.col("_at").alias("_item_at"), "_form", F.col("_slots").alias("_item_slots"), "_low", "_high")
    sizes = cut(items.groupBy("_item").agg(F.count_distinct(F.when(F.col("_level") == 0, F.col("_item_at"))).alias("_n")))
    bits = context.broadcast(bytes(_filter_bits(items)))
    found = _windows_of(docs, doc_id, text, words, bits).drop("_low", "_high")
    small = items.count() <= BROADCAST_WINDOWS
    side = F.broadcast(items) if small else items
    matches = found.join(side, ["_level", "_hash", "_form"])
    pairs = F.filter(F.arrays_zip(F.col("_item_slots").alias("item"), F.col("_slots").alias("doc")), lambda p: p["item"].isNotNull())
    aligned = matches.groupBy("_id", "_body", "_item", "_level", (F.col("_at") - F.col("_item_at")).alias("_offset")).agg(
        F.collect_set(F.struct("_low", "_high")).alias("_ranges"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("_pairs")
    )
    ends = [F.size(F.array_distinct(F.col(f"_pairs.{end}"))) for end in ("item", "doc")]
    consistent = aligned.filter((F.size("_pairs") == ends[0]) & (F.size("_pairs") == ends[1]))
    # No further than the item's last literal window.
    consistent = consistent.join(F.broadcast(sizes) if small else sizes, "_item").filter("_n > 0")
    ranges = F.filter(F.col("_ranges"), lambda r: r["_low"] < F.col("_n"))
    places = F.transform(ranges, lambda r: F.sequence(r["_low"], F.least(F.greatest(r["_low"], r["_high"]), F.col("_n") - 1)))
    consistent = consistent.withColumn("_places", F.array_distinct(F.flatten(places)))
    literal = F.when(F.col("_level") == 0, F.col("_places"))
    covered = consistent.groupBy("_id", "_body", "_item", "_n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).alias("_covered"),
        F.size(F.array_distinct(F.flatten(F.collect_list(literal)))).alias("_same"),
    )
    out = covered.select("_id", "_body", "_item", (F.col("_covered") / F.col("_n")).alias("_share"), (F.col("_same") / F.col("_n")).alias("_literal_share"))
    return out.filter(F.col("_share") >= share)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a contaminated text under its id (`_id`, `_body`): number and sorted ids of the items it contains, the largest share."""
    pairs = contamination(docs, benchmark, doc_id, text, **options)
    return pairs.groupBy("_id", "_body").agg(
        F.count("*").alias("_n_items"),
        F.array_join(F.transform(F.sort_array(F.collect_list("_item")), lambda i: i.cast("string")), ",").alias("_items"),
        F.max("_share").alias("_max_share"),
        F.max("_literal_share").alias("_max_literal"),
    )
