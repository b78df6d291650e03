"""WARC packages, Merkle manifests and collocations: edge cases, brute force, round trips."""

import base64
import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandwise.llm import collocations, merkle, quotient, warc
from bandwise.llm.common import placed, table

# --- WARC ---------------------------------------------------------------------------------------------------------


def _pages(spark, rows):
    full = [(*r, "x", "x", 1) for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, _sha string, _body string, _first int")


def _read(packages, **options):
    return warc.resolve_revisits(warc.read_records(warc.locate_records(packages), **options))


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_packages_keep_every_page(spark):
    long = "long é " * 300_000
    rows = [(3, "http://a/ b\r\nx: y", "same"), (1, None, "same"), (2, "http://b/%20", None), (4, "http://c", ""), (None, "http://d", "same"), (5, "", long), (6, "é", "\r\n\r\nWARC/1.1\r\n")]
    found = _read(warc.write_packages(_pages(spark, rows)), with_payload=True).collect()
    assert len(found) == len(rows)
    got = {r["_id"]: r for r in found}
    for page, uri, html in rows:
        r = got[None if page is None else str(page)]
        assert r["_uri"] == {"http://a/ b\r\nx: y": "http://a/%20b%0D%0Ax:%20y"}.get(uri, uri) and r["_valid"]
        assert r["_bytes"] == len((html or "").encode()) and r["_digest"] == _digest(html)
        if r["_type"] == "response":
            assert bytes(r["_payload"]).decode() == (html or "")
    assert {i: (r["_type"], r["_refers_id"]) for i, r in got.items() if r["_digest"] == _digest("same")} == {
        "1": ("response", None),
        "3": ("revisit", "1"),
        None: ("revisit", "1"),
    }
    assert got["4"]["_refers_id"] == "2"


def test_small_payloads_are_all_responses(spark):
    found = _read(warc.write_packages(_pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least_bytes=3))
    assert {r["_id"]: r["_type"] for r in found.collect()} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_repeated_and_null_ids_and_nothing(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (None, "u", "c"), (None, "v", "c")]
    found = sorted((r["_id"] or "-", r["_type"], r["_refers_id"] or "-", r["_bytes"]) for r in _read(warc.write_packages(_pages(spark, rows))).collect())
    assert found == [("-", "response", "-", 1), ("-", "response", "-", 1), ("1", "response", "-", 1), ("1", "response", "-", 1), ("1", "response", "-", 1), ("2", "revisit", "1", 1)]
    assert _read(warc.write_packages(_pages(spark, []))).count() == 0


def test_packages_are_split_and_listed(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} " + "x" * (i % 7)) for i in range(300)]
    packages = warc.write_packages(_pages(spark, rows), folder=f"{tmp_path}/out", package_bytes=2000)
    assert packages.count() > 20 and packages.agg(F.sum("_records")).first()[0] == 300
    found = _read(warc.list_packages(spark, f"{tmp_path}/out")).collect()
    assert sorted(int(r["_id"]) for r in found) == list(range(300))


class _File(io.BytesIO):
    def read_at(self, size, offset):
        self.seek(offset)
        return self.read(size)


def _zip(parts, ahead=b"", comment=b"", big=False, monkeypatch=None, method=zipfile.ZIP_STORED):
    if big:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name) if method == zipfile.ZIP_STORED else name, data)
        z.comment = comment
    data = ahead + out.getvalue()
    return _File(data), len(data)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("ahead", [b"", b"#!/bin/sh\nexit\n" * 3])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end record, only a comment"])
def test_directories(big, ahead, comment, monkeypatch):
    parts = {"archive/a.warc": b"AAAA" * 10, "notes é.txt": b"n" * 33, "indexes/i.cdxj": b""}
    file, size = _zip(parts, ahead, comment, big, monkeypatch)
    if big:
        assert b"PK\x06\x06" in file.getvalue()
    found = {m.name: file.read_at(m.size, warc.data_place(file, m)) for m in warc.members(file, size)}
    assert found == parts


def test_directories_of_many_members_and_bad_files():
    parts = {f"{'n' * 200}/{i}": b"%d" % i for i in range(7000)}  # the directory takes several reads
    file, size = _zip(parts)
    assert sum(1 for _ in warc.members(file, size)) == 7000
    for bad in (b"", b"nothing", file.getvalue()[:-50]):
        with pytest.raises(ValueError):
            list(warc.members(_File(bad), len(bad)))
    packed, size = _zip({"archive/a.warc": b"x" * 1000}, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        list(warc.package_ranges(packed, size))


def test_members_without_index_are_read_through():
    records = [warc.record_bytes(str(i), "http://u", b"p" * (i * 400_000)) for i in range(4)]
    packed = [zlib.compress(r, 1, 31) for r in records]
    file, size = _zip({"archive/a.warc.gz": b"".join(packed), "archive/b.warc": b"".join(records)})
    found = [warc.parse_record(file.read_at(n, at)) for at, n in warc.package_ranges(file, size)]
    assert [(f["warc-record-id"], len(p)) for f, p in found] == [(f"<urn:record:{i}>", i * 400_000) for i in range(4)] * 2


def test_an_index_that_points_outside_is_refused():
    file, size = _zip({"archive/a.warc": b"x" * 10, "indexes/i.cdxj": b'a 1 {"filename": "a.warc", "offset": "5", "length": "6"}\n'})
    with pytest.raises(ValueError, match="outside"):
        list(warc.package_ranges(file, size))


# --- Merkle -------------------------------------------------------------------------------------------------------


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _climb(nodes):
    """Root and, per leaf, its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            first = place // 8 * 8
            paths[leaf].append((nodes[first:place], nodes[place + 1 : first + 8]))
        nodes = [_sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], paths


def _brute(rows):
    leaves = [(r, _sha("".join(map(_encoded, r)))) for r in rows]
    groups = {}
    for r, leaf in leaves:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: (sorted(groups[g]), *_climb([x[2] for x in sorted(groups[g])])) for g in order}
    root, above = _climb([done[g][1] for g in order])
    out = []
    for g, upper in zip(order, above):
        for (known, i, leaf), path in zip(done[g][0], done[g][2]):
            proof = _sha("".join("".join(a + b) for a, b in path + upper))
            out.append((i if known else None, leaf, done[g][1], root, proof))
    return sorted(out, key=repr)


def _docs(spark, rows):
    full = [(*r, "x", "x") for r in rows]
    return spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, _id string, _group string")


def _proved(docs, **options):
    rows = merkle.proofs(merkle.manifest(docs, **options))
    h = merkle.as_hex
    return rows.select("_id", h(F.col("_node")).alias("leaf"), h(F.col("_subroot")).alias("subroot"), h(F.col("_root")).alias("root"), "_proof", "_verified").collect()


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9, "": 1, "é": 65, "z": 7}, {"a": 4098, "b": 4096, "c": 513}])
def test_manifest_against_brute_force(spark, sizes):
    rows = [(i if i % 50 else None, "s" if i % 3 else None, g, i if i % 2 else None, None if i % 11 == 0 else f"Text é {i}") for g, n in sizes.items() for i in range(n)]
    got = _proved(_docs(spark, rows))
    assert all(r["_verified"] for r in got)
    assert sorted([(r["_id"], r["leaf"], r["subroot"], r["root"], r["_proof"]) for r in got], key=repr) == _brute(rows)


def test_manifest_finds_changes(spark):
    rows = [(i, "s", "en", 4, "ABC" if i % 2 else "abc") for i in range(100)]
    got = _proved(_docs(spark, rows), changed={"text": F.lower("text")})
    assert {r["_id"] for r in got if not r["_verified"]} == {i for i in range(100) if i % 2}


def test_manifest_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, None, None, None, "x" * 200_000)] * 20 + [(2, "", "", 0, "")]
    got = _proved(_docs(spark, rows))
    assert len(got) == 21 and len({r["root"] for r in got}) == 1 and all(r["_verified"] for r in got)
    assert sorted([(r["_id"], r["leaf"], r["subroot"], r["root"], r["_proof"]) for r in got], key=repr) == _brute(rows)
    assert _proved(_docs(spark, [])) == []


def test_places_spread_a_large_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"), ((F.col("id") * 7919) % 20_011).alias("v"))
    got = placed(rows, "g", ["v"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("_at")
        assert (part["_at"].to_numpy() == np.arange(len(part))).all() and part["v"].is_monotonic_increasing and (part["_n"] == len(part)).all()


# --- Filters and collocations ----------------------------------------------------------------------------------------


@given(st.integers(1, 33), st.integers(2, 5), st.integers(0, 6), st.data())
@settings(max_examples=60, deadline=None)
def test_filters_lose_nothing(bits, words, shard_bits, data):
    ids = np.array(data.draw(st.lists(st.lists(st.integers(0, (1 << bits) - 1), min_size=words, max_size=words), min_size=1, max_size=40)))
    sizes = quotient.widths(words, bits)
    shard_bits = min(shard_bits, sizes[0])
    key = quotient.permute(quotient.pack(list(ids.T), bits), words, bits)
    assert all((part >> np.uint64(size - 1) <= 1).all() for part, size in zip(key, sizes))
    back = quotient.unpack(quotient.permute(key, words, bits, undo=True), words, bits)
    assert (np.array(back).T == ids).all()
    parts, counts = quotient.counted(key, None, sizes)
    counts = counts + np.where(np.arange(len(counts)) % 3 == 0, 1 << 40, 253)
    shards = parts[0] >> np.uint64(sizes[0] - shard_bits) if shard_bits else np.zeros(len(counts), np.uint64)
    found = []
    for shard in np.unique(shards):
        own = shards == shard
        data_bytes = quotient.encode([p[own] for p in parts], counts[own], sizes, shard_bits)
        found.append(quotient.decode(data_bytes, sizes, int(shard), shard_bits))
    again, sums = quotient.merged(found, sizes)
    assert all((a == b).all() for a, b in zip(again, parts)) and (sums == counts).all()
    _, doubled = quotient.merged([*found, *found], sizes)
    assert (doubled == 2 * counts).all()


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 1 << 14, 100_000) for _ in range(2)]
    sizes = quotient.widths(2, 14)
    parts, counts = quotient.counted(quotient.permute(quotient.pack(ids, 14), 2, 14), None, sizes)
    assert len(quotient.encode(parts, counts, sizes)) < 4.5 * len(counts)


def _expected(rows, least, top, longest=5):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        scored = []
        for phrase, a in own.items():
            if len(phrase) < 2 or a < least:
                continue
            score, k = min((1000 * a * totals[lang] // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase)))
            if not any(f >= a and len(q) > len(phrase) and any(q[i : i + len(phrase)] == phrase for i in range(len(q))) for q, f in own.items() if f >= least):
                scored.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def _found(spark, rows, **options):
    schema = "doc_id long, lang string, text string, _lang string, _word string, _n string"
    docs = spark.createDataFrame([(i, *r, "x", "x", "x") for i, r in enumerate(rows)], schema)
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


def _texts():
    rng = np.random.default_rng(5)
    words = ["The", "of", "new", "york", "é\x0bß", "a\tb", "x;", "data", "q!", "word", "\x1f"]
    rows = [(["en", None, "und", ""][i % 4], " ".join(rng.choice(words, size=int(rng.integers(0, 60)), p=np.arange(11, 0, -1) / 66))) for i in range(120)]
    return [*rows, ("en", None), ("en", ""), (None, "..."), ("en", "new york city hall " * 30), *[("fr", "new york")] * 9]


@pytest.mark.parametrize("dictionary_bytes", [collocations.DICTIONARY_BYTES, 0])
def test_collocations_against_brute_force(spark, dictionary_bytes):
    rows = _texts()
    expected = _expected(rows, 4, 25)
    assert len(expected) > 60
    assert _found(spark, rows, least=4, top=25, dictionary_bytes=dictionary_bytes) == expected


def test_collocations_in_small_pieces(spark, monkeypatch):
    """Slices, chunks and flushes within texts lose nothing: run the task functions in this process."""
    import pyarrow as pa

    for name, value in (("SLICE", 40), ("CHUNK", 16), ("HELD_ENTRIES", 50)):
        monkeypatch.setattr(collocations, name, value)
    rows = [("en", ("alpha beta gamma delta. beta gamma " * 40).encode()), ("fr", b"beta gamma " * 9)]
    ids = {w: i + 1 for i, w in enumerate([b"alpha", b"beta", b"gamma", b"delta"])}

    class Held:
        value = {"en": ids, "fr": ids}

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["_lang", "_text"])
    got = Counter()
    for out in collocations._ngrams(Held, [2, 3, 4, 5], 3, 2, None)(iter([batch])):
        for lang, words, shard, data in zip(*[c.to_pylist() for c in out.columns]):
            sizes = quotient.widths(words, 3)
            parts, counts = quotient.decode(data, sizes, shard, min(2, sizes[0]))
            for *key, n in zip(*quotient.unpack(quotient.permute(parts, words, 3, undo=True), words, 3), counts):
                got[lang, tuple(int(x) for x in key)] += int(n)
    expected = Counter()
    for lang, text in rows:
        for piece in text.split(b"."):
            codes = [ids[w] for w in piece.split()]
            for k in range(2, 6):
                expected.update((lang, tuple(codes[i : i + k])) for i in range(len(codes) - k + 1))
    assert got == expected


def test_collocations_of_nothing(spark):
    assert _found(spark, [], least=2) == [] and _found(spark, [("en", None), (None, "one two three")], least=2) == []


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 10**14, 10**12, 10**12)], "a long, n long, l long, r long")
    got = rows.select(collocations._product(F.lit(1000), "a", "n").alias("t"), collocations._product("l", "r").alias("b")).selectExpr("t div b").first()[0]
    assert got == 10**5


def test_tables_have_what_the_queries_claim(spark):
    """The supplied tables hold phrases, equal payloads or not, and several languages."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert docs.select("lang").distinct().count() > 3
    assert struct.calcsize("<QB") == 9
