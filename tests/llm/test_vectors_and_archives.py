"""Vector codes, centroid clusters and WARC archives against plain Python, on odd rows and against their SQL."""

import glob
import hashlib
import io
import random
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import centroids, queries, vector_codes, warc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, id string, cluster string"


def floors(rows, scale, dims=None):
    """(id, label, integers) of the usable rows, as the contracts spell it."""
    out = []
    for i, vector, label, *_ in rows:
        if vector is None or any(x is None or not np.isfinite(x) for x in vector) or dims and len(vector) != dims:
            continue
        out.append((i, label, [int(np.floor(scale * float(np.float32(x)))) for x in vector]))
    return out


def nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(entries))


def coded(rows, parts, entries, rounds, scale):
    kept = [r for r in floors(rows, scale) if r[2]]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out, by_label = [], {}
    for i, label, v in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), error))
    return sorted(((*r, by_label[r[1]]) for r in out), key=str), ",".join(str(x) for p in books for e in p for x in e)


def clustered(rows, clusters, rounds, scale, dims):
    kept = floors(rows, scale, dims)
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))
    centres = [r[2] for r in order[:clusters]]
    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            groups.setdefault(nearest(v, centres)[1], []).append(v)
        for k, g in groups.items():
            centres[k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(i, *nearest(v, centres)) for i, _, v in kept]
    inertia = {k: sum(d for _, d, c in found if c == k) for k in range(len(centres))}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def vectors(seed, n=300, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(0, 0.15, dims).astype("f4")
        if i % 3 == 0:
            v = np.round(v * 4) / 4  # many ties and equal parts
        if i % 5 == 0:
            v = np.full(dims, 0.125, "f4")  # one common vector
        rows.append((i, [float(x) for x in v], None if i % 4 == 0 else i % 7))
    odd = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [0.5] * (dims - 1)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd[:5])] + [rows[7], rows[7], (None, rows[8][1], None)]
    return rows, (2000, odd[5], 2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "c") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_codes_equal_brute_force(spark, n):
    rows, short = vectors(n)
    rows = rows[:n] if n < 300 else rows
    out, books = vector_codes.compress(frame(spark, [*rows, short] if n else []), entries=16, rounds=3)
    if not n:
        assert books is None and out.count() == 0
        return
    want, text = coded(rows, 8, 16, 3, 4096)
    assert vector_codes.spelled(books) == text
    assert sorted(map(tuple, out.collect()), key=str) == want


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_clusters_equal_brute_force(spark, n):
    rows, short = vectors(n + 1)
    rows = rows[:n] if n < 300 else rows
    out, centres = centroids.cluster(frame(spark, [*rows, short] if n else []))
    assert sorted(map(tuple, out.collect()), key=str) == (clustered(rows, 16, 3, 64, 64) if n else [])
    assert len(centres) == min(16, n)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_trie_walk(monkeypatch, block):
    """Subtrees of any size give the nearest entry, ties to the lower index."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = np.unique(rng.integers(-3, 4, (500, 5)), axis=0)
    book = rng.integers(-3, 4, (16, 5))
    book[9] = book[2]
    entry, distance = vector_codes.nearest_entries(rows, book)
    d = ((rows[:, None] - book[None]) ** 2).sum(-1)
    assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all() and not (entry == 9).any()
    there, which = vector_codes.distinct_rows(rows[rng.integers(0, len(rows), 900)])
    assert len(np.unique(which)) == len(there)


def test_orchard_search_saves_distances_and_is_exact():
    rng = np.random.default_rng(4)
    centres = rng.integers(-100, 100, (64, 8))
    centres[40] = centres[3]
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-6, 7, (2000, 8))
    best, distance, computed = centroids.orchard(x, centres, centroids.neighbour_lists(centres))
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert (best == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert computed < 0.6 * d.size


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_warc", "op13_centroids"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# archives

PAGES = "page_id long, url string, html string, payload string, first string, digest string"


def pages(spark):
    rng = random.Random(3)
    words = [f"<p class='w{i}'>word {i}</p>" for i in range(200)]
    text = lambda k: "".join(rng.choice(words) for _ in range(k)) + str(k)
    rows = [(i, f"http://h/{i}", text(rng.randint(1, 60))) for i in range(400)]
    copy, small = text(40) + "é日本", "x" * 99
    rows += [(i, "http://copy/", copy) for i in (950, 901, 933, 901)] + [(None, None, copy)] + [(i, "http://small/", small) for i in (971, 970)]
    rows += [(980, None, None), (981, "", ""), (982, "http://a b\r\nX: 1", "y" * 3_000_000), (983, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "n", "n" * 200), (None, "m", "n" * 200)]
    return [(*r, "p", "f", "d") for r in rows]


def plain_rows(rows):
    first = {}
    for i, _, html, *_ in rows:
        html = html or ""
        if i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        later = len(raw) >= 100 and first.get(html or "") != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", first[html or ""] if later else None))
    return sorted(out, key=str)


def test_archives_equal_plain_python(spark):
    rows = pages(spark)
    out = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3))
    got = sorted(map(tuple, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == plain_rows(rows)


def test_archives_are_standard_files(spark, tmp_path):
    """Each file: one dictionary frame first, frames of one record each; any Zstandard stream reader reads it."""
    rows = pages(spark)
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path)
    files = glob.glob(f"{path}/part-*")
    assert len(files) == 2
    records, raw_size = 0, 0
    for name in files:
        content = open(name, "rb").read()
        magic, n = struct.unpack_from("<II", content)
        assert magic == warc.DICTIONARY_MAGIC
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + n])
        at, inside = 8 + n, 0
        while at < len(content):
            if content[at : at + 8] == warc.EMPTY_FRAME:
                at += 8
                continue
            start = at
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            plain = one.decompress(content[at:])
            at = len(content) - len(one.unused_data)
            assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
            assert zstandard.get_frame_parameters(content[start:at]).dict_id == dictionary.dict_id()
            inside += 1
            raw_size += len(plain)
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert stream.count(b"WARC/1.1\r\nWARC-Type") == inside == sum(1 for _ in warc.read_records(content))
        records += inside
    assert records == len(rows) and sum(len(open(f, "rb").read()) for f in files) < raw_size / 4
    payloads = {(r["page_id"], r["url"]): r["payload"] for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    assert all(payloads.get((i, u), (h or "").encode()) == (h or "").encode() for i, u, h, *_ in rows)
    assert payloads[982, "http://a%20b%0D%0AX:%201"] == b"y" * 3_000_000
    urns = [r["record_id"] for r in warc.read_archives(spark, path).filter("page_id IS NOT NULL AND page_id <> 901").collect()]
    assert len(set(urns)) == len(urns)


def test_empty_and_few_pages(spark):
    few = spark.createDataFrame([(1, "u", "short")], "page_id long, url string, html string").repartition(1)
    assert [tuple(r)[:4] for r in warc.round_trip(few).collect()] == [(1, "u", "response", 5)]
    assert warc.round_trip(few.filter("page_id > 5")).count() == 0


def test_damaged_archives_are_refused(spark, tmp_path):
    made = b"".join(warc.archive(iter([warc.record("1", "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, "2000-01-01T00:00:00Z", "0")])))
    with pytest.raises(ValueError):
        list(warc._parsed(True)(iter([pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["content"])])))
    lost = warc.record("2", "u", b"abc", hashlib.sha256(b"abc").hexdigest(), "1", "2000-01-01T00:00:00Z", "0")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.zst").write_bytes(b"".join(warc.archive(iter([lost]))))
    with pytest.raises(Exception, match="no response of the same payload"):
        warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).collect()


def test_ids_of_other_types(spark):
    rows = [("a%b\n", "u", "z" * 150), ("é", "v", "z" * 150)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {("a%b\n", "response", None), ("é", "revisit", "a%b\n")}


def test_nothing_is_left_to_the_order_of_rows(spark):
    rows, _ = vectors(9)
    one = vector_codes.compress(frame(spark, rows), rounds=2)[0].collect()
    two = vector_codes.compress(frame(spark, rows[::-1]).repartition(7, F.rand(1)), rounds=2)[0].collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)
