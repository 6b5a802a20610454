import gzip
import hashlib
import random

from ticksmith.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload_digest string"
LONG = "<p>" + "same " * 40 + "</p>"


def pages(spark):
    data = [(i, f"http://a/{i}", f"<p>page {i} " + "x" * (i % 7) * 30, "z") for i in range(50)]
    data += [(60 + i, "http://b/ü \n", LONG, "z") for i in range(5)] + [(60, None, LONG, "z"), (None, "u", LONG, "z")]
    data += [(70, "u", None, "z"), (71, "u", "", "z"), (72, "u", "short", "z"), (73, "u", "short", "z"), (74, "u", "é" * 300000, "z")]
    data += [(75, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "z"), (None, "u", "only ids missing " * 20, "z")]
    return data


def want(data):
    first = {}
    for i, _, h, _ in data:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, _ in data:
        b = (h or "").encode()
        f = first.get(h)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    data = pages(spark)
    df = spark.createDataFrame(data, SCHEMA)
    for compress in (True, False):
        got = sorted((tuple(r) for r in W.archive_round_trip(df, compress).collect()), key=repr)
        assert got == want(data)
    assert W.archive_round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_warc(spark, scratch):
    df = spark.createDataFrame(pages(spark), SCHEMA)
    W.write_archives(df, scratch + "/z", compress=True)
    import glob
    raw = b"".join(gzip.decompress(open(f, "rb").read()) for f in sorted(glob.glob(scratch + "/z/part*")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: re") >= df.count()


def _records(n=40, compress=True):
    rng = random.Random(n)
    parts = []
    for i in range(n):
        body = bytes(rng.randrange(32, 127) for _ in range(rng.randint(0, 900)))
        raw = W.record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), "response", None)
        parts.append(gzip.compress(raw) if compress else raw)
    return parts


def _ids(data):
    return [W._page(h["warc-record-id"]) for kind, _, _, h, _ in W.salvage(data) if kind == "record"]


def _tiles(data):
    at = 0
    for _, offset, length, _, _ in W.salvage(data):
        assert offset >= at and not data[at:offset].strip(b"\0")
        at = offset + length
    assert not data[at:].strip(b"\0")


def test_salvage_skips_only_what_is_damaged():
    for compress in (True, False):
        parts = _records(compress=compress)
        clean = b"".join(parts)
        assert _ids(clean) == list(range(40))
        for k in (0, 7, 39):
            start = sum(map(len, parts[:k]))
            for damage in (lambda d: d[:start + 40] + bytes([d[start + 40] ^ 255]) + d[start + 41:],      # one byte
                           lambda d: d[:start + 25] + d[start + len(parts[k]) - 25:],                     # a hole
                           lambda d: d[:start] + b"\x1f\x8b\x08 noise WARC/1.1 \n" + d[start + 30:],      # overwritten start
                           lambda d: d[:start] + d[start + 12:]):                                          # lost start
                bad = damage(clean)
                got = _ids(bad)
                assert [i for i in got if i != k] == [i for i in range(40) if i != k]
                assert k not in got
                gaps = [x for x in W.salvage(bad) if x[0] == "gap"]
                assert gaps and sum(g[2] for g in gaps) <= len(parts[k]) + 40
                _tiles(bad)


def test_salvage_of_rubbish():
    for data in (b"", b"\0\0\0", b"no warc at all", b"\x1f\x8b", gzip.compress(b"not a record"), b"WARC/1.1\r\n",
                 b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", b"\x1f\x8b\x08" * 1000):
        assert all(x[0] == "gap" for x in W.salvage(data))
        _tiles(data)


def test_random_damage_loses_few_records():
    rng = random.Random(8)
    clean = b"".join(_records(60))
    for _ in range(40):
        bad = bytearray(clean)
        for _ in range(3):
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        got = _ids(bytes(bad))
        assert len(got) >= 57 and got == sorted(got)
        _tiles(bytes(bad))


def test_gaps_are_logged(spark, scratch):
    parts = _records(10)
    import os
    os.makedirs(scratch + "/w")
    bad = bytearray(b"".join(parts))
    bad[len(parts[0]) + 30] ^= 255
    open(scratch + "/w/a.warc.gz", "wb").write(bad)
    got = W.read_archives(spark, scratch + "/w").collect()
    assert [r.page_id for r in got if r.entry == "record"] == [0, 2, 3, 4, 5, 6, 7, 8, 9]
    gap = [r for r in got if r.entry == "gap"]
    assert len(gap) == 1 and gap[0].at == len(parts[0]) and gap[0].length == len(parts[1]) and gap[0].reason
