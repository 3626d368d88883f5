"""Operators 2, 5, 6, 8 and 10, and the pipeline."""

import math
import random
import struct
from collections import Counter
from datetime import datetime
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from llm_cases import ODD

from redactrail.llm import avi_media, quality, url_filter, voronoi_knn, warc_revisits

SMALL = "/root/testdata/sf0.001"


# 2


def record(kind, url, date, http=b"", payload=b"", ident="<urn:1>"):
    body = http + b"\r\n\r\n" + payload if http else payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
    head += "Content-Type: application/http; msgtype=response\r\n" if http else ""
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc_files_and_revisits(spark):
    import gzip

    response = record("response", "http://Example.com/a/?utm_source=x", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\nVary: a", b"<html>", "<r1>")
    revisit = record("revisit", "https://www.example.com/a#top", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\nContent-Type: no\r\nVary: b", b"", "<v1>")
    files = spark.createDataFrame([(gzip.compress(response) + gzip.compress(revisit), 1), (b"broken", 2), (None, 3), (b"", 4)], "content binary, type int")
    records = warc_revisits.read_warc(files)
    assert records.where("error IS NULL").count() == 2 and records.where("error IS NOT NULL").count() == 1
    found = warc_revisits.resolve(records).collect()
    assert len(found) == 1 and found[0]["resolved"] and found[0]["reason"] == "etag" and found[0]["refers_to"] == "<r1>"
    assert found[0]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "vary": "b"}
    assert found[0]["payload_sha256"] == sha256(b"<html>").hexdigest()


def test_damaged_warc_files(monkeypatch):
    import gzip

    monkeypatch.setattr(warc_revisits, "STRETCH", 256)
    each = [record("response", f"http://a.b/{i}", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nVary: a\r\nVary: b", bytes(300) + b"x" * (97 * i), f"<{i}>") for i in range(6)]
    zipped = [gzip.compress(x) for x in each]
    got = lambda data: [(r["warc"].get("warc-record-id"), r["error"]) for r in warc_revisits.parse(data)]
    whole = [(f"<{i}>", None) for i in range(6)]
    assert got(b"".join(each)) == got(b"".join(zipped)) == got(gzip.compress(b"".join(each))) == whole
    assert [len(r["payload"]) for r in warc_revisits.parse(b"".join(zipped))] == [300 + 97 * i for i in range(6)]
    assert {r["http"]["vary"] for r in warc_revisits.parse(each[0])} == {"a, b"}
    for data in (each[0] + each[1][:-200] + b"".join(each[2:]), zipped[0] + gzip.compress(each[1][:-200]) + b"".join(zipped[2:])):
        assert got(data) == [whole[0], ("<1>", "cut short"), *whole[2:]]
    assert got(b"".join(each)[:-100]) == [*whole[:5], ("<5>", "cut short")]
    assert got(b"".join(zipped)[:-20])[:5] == whole[:5] and got(b"".join(zipped)[:-20])[-1] == (None, "a compressed member is cut short or damaged")
    damaged = zipped[1][:40] + bytes(9) + zipped[1][49:]
    found = got(zipped[0] + damaged + b"".join(zipped[2:]))
    assert [x for x in found if x[1] is None] == [whole[0], *whole[2:]] and len(found) > 5
    assert list(dict.fromkeys(got(each[0] + b"garbage" * 100 + each[1]))) == [whole[0], (None, "no record here"), whole[1]]  # a row for each stretch
    assert got(zipped[0] + b"garbage" * 100 + zipped[1]) == [whole[0], (None, "no compressed member here"), whole[1]]
    assert [x for x in got(each[0].replace(b"Content-Length", b"Content-Size") + each[1]) if x != (None, "no record here")] == [("<0>", "no length"), whole[1]]
    assert got(b"WARC/1.1\r\nno end") == [(None, "headers without an end")] and got(b"") == []


def test_written_warc_files_read_back(spark):
    rows = [(str(i), "response", f"http://a.b/{i}" if i % 5 else None, datetime(2024, 1, 1, 0, 0, i) if i % 7 else None, 200, {"ETag": str(i), "None": None} if i % 3 else None, bytes([i]) * 10 if i % 4 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "record_id string, type string, url string, ts timestamp, status int, headers map<string,string>, payload binary")
    found = {r["record_id"]: r for r in warc_revisits.read_warc(warc_revisits.write_warc(df.repartition(3))).collect()}
    for i, kind, url, ts, status, headers, payload in rows:
        r = found[i]
        assert (r["type"], r["url"], r["ts"], r["status"], bytes(r["payload"]), r["error"]) == (kind, url, ts, status, payload or b"", None)
        assert r["headers"] == {k.lower(): v for k, v in (headers or {}).items() if v is not None}


def test_revisits_by_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        url = r.choice(["http://hot.example.com/x", "http://hot.example.com/x/", f"http://a.example.com/{r.randrange(30)}", None, "no url"])
        tag = {"ETag": r.choice(['"1"', '"2"'])} if r.random() < 0.7 else {"Last-Modified": r.choice(["m", "n"])} if r.random() < 0.7 else None
        rows.append((i, r.choice(["response", "revisit", "request"]), url, r.choice([None, *range(60)]), r.choice([200, 200, 200, 404]), tag, f"sha{i}", "clash"))
    df = spark.createDataFrame(rows, "record_id long, type string, url string, ts long, status int, headers map<string,string>, payload_sha256 string, canon string")
    canon = lambda u: u and u.removesuffix("/").removeprefix("http://") if u != "no url" else u
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for parts in (1, 7):
        found = {x["record_id"]: x for x in warc_revisits.resolve(df, parts).collect()}
        assert len(found) == sum(x[1] == "revisit" for x in rows)
        for i, kind, url, ts, _, headers, *_ in rows:
            if kind != "revisit":
                continue
            full = [x for x in rows if x[1] == "response" and x[4] == 200 and url is not None and canon(x[2]) == canon(url) and x[3] is not None and ts is not None and x[3] < ts]
            best = max(full, key=lambda x: (x[3], x[0]), default=None)
            expected = "no earlier response" if best is None else warc_revisits.matching(low(headers), low(best[5]))
            assert found[i]["reason"] == expected, (i, found[i], best)
            assert found[i]["refers_to"] == (best[0] if expected in ("etag", "last-modified") else None)
    assert warc_revisits.resolve(df.limit(0)).collect() == []


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 0), (2, "", "x", 0), (2, "http://a/b", "x", 0), (None, "http://a/b", "", 0)], "page_id long, url string, html string, ts int")
    assert warc_revisits.resolved_captures(pages).count() == 3


# 5


def test_quality_of_held_out_documents(spark):
    larger = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows if r["held_out"]]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_features_by_hand():
    """As many features as a plain count gives: words, pairs, and runs of 3 and 4 with their borders."""
    for text in ["", "a", "ab cd", "  naïve\tcafé  ", "one one two", "x" * 50]:
        words = text.split()
        expected = len(words) + max(0, len(words) - 1) + sum(len(w) + max(0, len(w) - 1) for w in words)
        assert len(quality.features(text)) == expected
        runs = [f" {w} "[i : i + n] for w in words for n in (3, 4) for i in range(len(w) + 3 - n)]
        pairs = [a + " " + b if a != b else "again" for a, b in zip(words, words[1:], strict=False)]
        plain = Counter([("word", w) for w in words] + [("pair", x) for x in pairs] + [(len(x), x) for x in runs])
        assert sorted(plain.values()) == sorted(Counter(quality.features(text).tolist()).values())
    same = set(quality.features("ab ab")) & set(quality.features("cd cd"))
    assert len(same) == 1  # the word that follows itself


def test_training_by_plain_loops(monkeypatch):
    """Against loops over single numbers, from the same first vectors and in the same order."""
    monkeypatch.setattr(quality, "DIM", 3)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    r = random.Random(4)
    rows = [(np.array(sorted(r.sample(range(30), 6))), np.array([r.randint(1, 3) for _ in range(6)], np.float32), int(i % 3 > 0)) for i in range(9)]
    model = quality.train(rows, 0.7, seed=5)
    order = np.random.default_rng(5)
    vectors = order.normal(0, 1 / 3, (quality.BUCKETS, 3))[:30].tolist()
    out, bias, at, steps = [[0.0] * 3, [0.0] * 3], [0.0, 0.0], 0, 2 * 2 * 6
    own = [[i for i, (*_, y) in enumerate(rows) if y == label] for label in (0, 1)]
    for _ in range(2):
        drawn = [order.permutation(own[label]).tolist() for label in (0, 1)]
        for i in order.permutation([x[k % len(x)] for x in drawn for k in range(6)]).tolist():
            buckets, counts, label = rows[i][0].tolist(), rows[i][1].tolist(), rows[i][2]
            rate = quality.RATE * (1 - at / steps)
            at += 1
            share = [c / sum(counts) for c in counts]
            mean = [sum(w * vectors[b][d] for w, b in zip(share, buckets, strict=True)) for d in range(3)]
            odds = [math.exp(sum(o * m for o, m in zip(out[k], mean, strict=True)) + bias[k]) for k in (0, 1)]
            error = [odds[k] / sum(odds) - (k == label) for k in (0, 1)]
            back = [sum(error[k] * out[k][d] for k in (0, 1)) for d in range(3)]
            for k in (0, 1):
                out[k] = [o - rate * error[k] * m for o, m in zip(out[k], mean, strict=True)]
                bias[k] -= rate * 0.1 * error[k]
            for w, b in zip(share, buckets, strict=True):
                vectors[b] = [v - rate * w / max(share) * g for v, g in zip(vectors[b], back, strict=True)]
    expected = [sum(v[d] * (out[1][d] - out[0][d]) for d in range(3)) for v in vectors]
    assert np.allclose(model.table[:30], expected, atol=1e-4) and abs(model.bias - (bias[1] - bias[0] + math.log(0.7 / 0.3))) < 1e-4


def test_quality_of_odd_rows(documents, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(documents(ODD), empty)
    assert {r["score"] for r in quality.scored(documents(ODD), model).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, "x"), (3, 0, "x"), (99, 0, "x"), (None, 1, "x"), (4, None, "x")], "doc_id long, quality int, text string")
    model = quality.fit(documents(ODD), one)
    rows = quality.scored(documents(ODD, [*range(9), None]), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(documents(ODD).limit(0), model).collect() == []
    kept = quality.accepted(documents(ODD), model)
    assert kept.columns == documents(["x"]).columns and kept.count() == len(ODD)


def test_long_texts_score_as_their_features_say():
    model = quality.Model(np.random.default_rng(1).normal(0, 1, quality.BUCKETS).astype(np.float32), 0.1)
    text = "some words " * 80_000
    own = quality.features(text)
    expected = 1 / (1 + math.exp(-(0.1 + model.table[own].sum(dtype=np.float64) / len(own))))
    assert abs(model.score(text) - expected) < 1e-3


# 6

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", ("example.com/en/7", "allow")),
    ("https://example.com/en/8", "example.com", "/en/8", ("com/en/", "block")),
    ("https://x.example.net/de/81", "x.example.net", "/de/81", ("example.net/de/8", "block")),
    ("https://notexample.net/de/81", "notexample.net", "/de/81", ("net/de/", "allow")),
    ("https://b.org", "b.org", "", None), ("https://b.org?q=/es/", "b.org", "", None), ("no url", "", "", None), (None, "", "", None),
    ("a://b://c/d", "b:", "//c/d", None), ("http://É.org/es/", "É.org", "/es/", ("org/es/", "block")),
])
def test_hosts_paths_and_rules(url, host, path, rule):
    assert url_filter.host_and_path(url) == (host, path)
    assert url_filter.Rules(RULES).best(host, path) == rule


def plain_verdicts(rows):
    """(page_id, verdict, score) by dictionaries of exact counts, rules in a loop, and every threshold tried."""

    def rule_of(url):
        fits = []
        host, path = url_filter.host_and_path(url)
        for verdict, rule in RULES:
            name, _, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((len(rule), verdict == "block", verdict))
        return max(fits)[2] if fits else None

    order, counts = url_filter.ORDER, [Counter(), Counter()]
    raw = lambda u: b"\2" * order + (u or "").encode().translate(url_filter.DIGITS)
    examples = [(u, rule_of(u) == "allow") for _, u in rows if rule_of(u)]
    held = [crc32(u.encode()) % url_filter.FOLDS == 0 for u, _ in examples]
    for (u, side), out in zip(examples, held, strict=True):
        for i in range(order, len(raw(u)) if not out else 0):
            for k in range(order + 1):
                counts[side][raw(u)[i - k : i + 1], None] += 1
                counts[side][raw(u)[i - k : i], k] += 1

    def score(u):
        data, total = raw(u), 0.0
        for i in range(order, len(data)):
            p = [1 / 256, 1 / 256]
            for side in (0, 1):
                for k in range(order + 1):
                    p[side] = (counts[side][data[i - k : i + 1], None] + url_filter.SMOOTHING * p[side]) / (counts[side][data[i - k : i], k] + url_filter.SMOOTHING)
            total += math.log(p[1]) - math.log(p[0])
        return total / max(1, len(data) - order)

    tested = [(score(u), side) for (u, side), out in zip(examples, held, strict=True) if out]
    steps = [-url_filter.SPAN + 2 * url_filter.SPAN * k / url_filter.STEPS for k in range(url_filter.STEPS + 1)]
    accepted, rejected = ([x for x, side in tested if side == y] for y in (True, False))
    quality = [sum(x < t for x in rejected) / len(rejected) + sum(x >= t for x in accepted) / len(accepted) for t in steps]
    threshold = min((t for t, q in zip(steps, quality, strict=True) if q >= max(quality) - 1e-9), key=abs)
    return [(i, rule_of(u) or ("allow" if score(u) >= threshold else "block"), score(u)) for i, u in rows]


def test_judged_pages_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    r = random.Random(3)
    rows = [tuple(x) for x in pages.collect()]
    rows += [(1000 + i, f"http://{r.choice(['good', 'fine'])}.example.net/de/{r.choice(['news', 'blog'])}{r.randrange(99)}") for i in range(60)]
    rows += [(2000 + i, f"http://{r.choice(['bad', 'fine'])}.example.org/es/{r.choice(['spam', 'win'])}{r.randrange(99)}") for i in range(60)]
    rows += [(3000 + i, f"http://{r.choice(['bad', 'good'])}.fr/{r.choice(['spam', 'news', 'x'])}") for i in range(40)] + [(4000, None), (4001, ""), (4002, "é")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    found = sorted((x["page_id"], x["verdict"], x["score"]) for x in url_filter.judged(df, url_filter.fit(df, RULES), RULES).collect())
    for (i, verdict, score), (j, plain, expected) in zip(found, sorted(plain_verdicts(rows)), strict=True):
        assert (i, verdict) == (j, plain) and abs(score - expected) < 1e-9
    assert {v for i, v, _ in found if i >= 3000} == {"allow", "block"}
    assert url_filter.calibrated(np.zeros((2, url_filter.STEPS))) == 0.0


def test_url_verdicts(spark):
    rows = [(i, f"http://{'shop' if i % 2 else 'news'}{i % 7}.example.{'org/es/' if i % 2 else 'net/de/'}{'casino' if i % 2 else 'article'}{i}", "x") for i in range(400)]
    rows += [(1000, "http://z.example.fr/casino5", "x"), (1001, "http://z.example.fr/article5", "x"), (1002, None, "x"), (1002, None, "x"), (None, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = url_filter.judged(pages, url_filter.fit(pages, RULES), RULES).collect()
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert verdict[1000] == "block" and verdict[1001] == "allow" and len(found) == len(rows)
    assert all(r["verdict"] == ("block" if r["rule"] == "org/es/" else "allow") for r in found if r["rule"])
    none = url_filter.fit(pages.limit(0), RULES)
    assert url_filter.judged(pages.limit(0), none, RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judged(pages.where("page_id >= 1000"), none, RULES).collect()} == {"allow"}


# 8


def test_media_round_trip(documents):
    df = documents(ODD)
    got = {r["doc_id"]: r for r in avi_media.digests(df).collect()}
    stored = avi_media.store(df)
    back = {r["doc_id"]: bytes(r["data"]) for r in avi_media.load(stored).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for i, text in enumerate(ODD):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert back[i] == data and got[i]["n_bytes"] == len(data) and got[i]["payload_bytes"] == len(payload)
        assert got[i]["payload_sha256"] == sha256(payload).hexdigest() and got[i]["tail_crc32"] == crc32(payload[-16:])
        assert got[i]["media_bytes"] == len(media[i]) and got[i]["media_sha256"] == sha256(media[i]).hexdigest()
    assert got[3][1:] == got[4][1:]
    assert avi_media.digests(df.limit(0)).collect() == []
    rows = avi_media.clips(stored).collect()
    assert all(sum(r["n_frames"] for r in rows if r["doc_id"] == i) == got[i]["payload_bytes"] // 192 for i in got)
    assert all(sum(r["doc_id"] == i for r in rows) == got[i]["n_clips"] for i in got)
    for i in got:
        own = sorted((r["start_ms"], r["end_ms"]) for r in rows if r["doc_id"] == i)
        assert got[i]["feature"].split("clips ")[1] == " ".join(f"{a:g}-{b:g}" for a, b in own)


def plain_lossless(frame):
    """A frame's samples by a reader of single bits."""
    at, table, size = 2, {}, None
    while True:
        kind, n = frame[at + 1], struct.unpack(">H", frame[at + 2 : at + 4])[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xC4:
            code, values = 0, iter(body[17:])
            for length, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    table[length, code] = next(values)
                    code += 1
                code <<= 1
        elif kind == 0xC3:
            size = struct.unpack(">HH", body[1:5])
        elif kind == 0xDA:
            break
    bits = iter("".join(f"{b:08b}" for b in frame[at:-2].replace(b"\xff\0", b"\xff")))
    rows = []
    for y in range(size[0]):
        rows.append([])
        for x in range(size[1]):
            code, length = 0, 0
            while (length, code) not in table:
                code, length = code * 2 + int(next(bits)), length + 1
            n = table[length, code]
            extra = int("".join(next(bits) for _ in range(n)) or "0", 2)
            d = extra if n == 0 or extra >> (n - 1) else extra - (1 << n) + 1
            before = rows[y][x - 1] if x else rows[y - 1][0] if y else 128
            rows[y].append((before + d) & 255)
    return [v for row in rows for v in row]


def test_frames_are_standard_lossless_jpeg():
    samples = np.random.default_rng(2).choice([0, 1, 97, 128, 255], (5, 192)).astype(np.uint8)
    frames = avi_media.encode_frames(samples)
    assert [plain_lossless(f) for f in frames] == samples.tolist()
    assert (avi_media.decode_frames(frames) == samples).all()


def test_index_order_shots_and_broken_files(spark):
    rng = np.random.default_rng(1)
    film = np.concatenate([rng.normal(m, 4, (20, 192)).clip(0, 255) for m in (40, 150, 90)]).astype(np.uint8)
    frames = avi_media.encode_frames(film)
    data = avi_media.write_avi(frames)
    assert avi_media.read_avi(data)[0] == frames
    at = data.rindex(b"idx1")
    assert avi_media.read_avi(data[:at] + b"JUNK" + data[at + 4 :])[0] == frames  # without an index, in the file's order
    swapped = bytearray(data)
    swapped[at + 8 : at + 24], swapped[at + 24 : at + 40] = data[at + 24 : at + 40], data[at + 8 : at + 24]
    assert avi_media.read_avi(bytes(swapped))[0] == [frames[1], frames[0], *frames[2:]]
    assert avi_media.shots(film, np.array([0]))[0].tolist() == [20, 40]
    df = spark.createDataFrame([(1, data, 0), (2, data[:500], 0), (3, b"", 0), (4, None, 0), (5, data.replace(b"\xff\xc3", b"\xff\xc2"), 0)], "doc_id long, media binary, clip int")
    rows = avi_media.clips(df).collect()
    assert [(r["start_ms"], r["end_ms"]) for r in rows if r["doc_id"] == 1] == [(0.0, 800.0), (800.0, 1600.0), (1600.0, 2400.0)]
    assert {r["doc_id"] for r in rows if r["error"]} == {2, 3, 5} and all(r["doc_id"] != 4 for r in rows)


def plain_shots(film):
    """Cuts by their definition, frame by frame."""
    levels = [Counter(int(x) // 16 for x in frame) for frame in film]
    d = [0.0] + [sum(abs(a[k] - b[k]) for k in range(16)) / (2 * len(film[0])) for a, b in zip(levels, levels[1:], strict=False)]
    cuts = []
    for i in range(1, len(film)):
        near = d[max(1, i - avi_media.WINDOW) : i + avi_media.WINDOW + 1]
        mean = sum(near) / len(near)
        spread = max(0.0, sum(x * x for x in near) / len(near) - mean * mean) ** 0.5
        if d[i] > mean + avi_media.DEVIATIONS * spread + 1e-9 and d[i] >= avi_media.LEAST_CUT:
            cuts.append(i)
    return cuts


def test_shots_by_brute_force():
    rng = np.random.default_rng(8)
    films = [np.concatenate([rng.normal(m, s, (n, 192)).clip(0, 255) for m, s, n in zip(rng.integers(20, 230, 12), rng.integers(1, 60, 12), rng.integers(1, 30, 12), strict=True)]).astype(np.uint8) for _ in range(6)]
    starts = np.cumsum([0, *map(len, films[:-1])])
    found = [x.tolist() for x in avi_media.shots(np.concatenate(films), starts)]
    assert found == [plain_shots(f) for f in films] and sum(map(len, found)) > 10


def test_rec_lists_dropped_frames_and_streams(spark):
    film = np.concatenate([np.full((10, 192), 30), np.full((10, 192), 200)]).astype(np.uint8)
    frames = avi_media.encode_frames(film)
    data = avi_media.write_avi(frames)
    movie, index = data.index(b"movi") - 8, data.rindex(b"idx1")
    head = data[12:movie]
    chunk, group = avi_media._chunk, lambda parts: avi_media._chunk(b"LIST", b"rec " + b"".join(parts))
    build = lambda head, parts: avi_media._chunk(b"RIFF", b"AVI " + head + avi_media._chunk(b"LIST", b"movi" + b"".join(parts)))
    by_two = [group([chunk(b"00dc", a), chunk(b"01wb", b"sound"), chunk(b"00dc", b)]) for a, b in zip(frames[::2], frames[1::2], strict=True)]
    assert avi_media.read_avi(build(head, by_two))[0] == frames and index > movie
    dropped = [b"" if i in (3, 4, 12) else f for i, f in enumerate(frames)]
    lossy = avi_media.write_avi(dropped)
    assert avi_media.read_avi(lossy)[0] == dropped and (avi_media.frame_samples(dropped) == film).all()
    other = avi_media.encode_frames(255 - film)
    stream = head[head.index(b"LIST", 20) :]  # the stream's own list
    sound = stream.replace(b"vidsMJPG", b"auds\0\0\0\0")
    both = chunk(b"LIST", head[8 : head.index(b"LIST", 20)] + sound + stream + stream)
    mixed = [x for f, g in zip(frames, other, strict=True) for x in (chunk(b"00wb", b"s"), chunk(b"01dc", f), chunk(b"02dc", g))]
    assert avi_media.read_avi(build(both, mixed))[0] == frames
    df = spark.createDataFrame([(1, build(head, by_two)), (2, lossy), (3, build(both, mixed)), (4, avi_media.write_avi([b"", b""]))], "doc_id long, media binary")
    rows = sorted((r["doc_id"], r["start_ms"], r["end_ms"], r["error"]) for r in avi_media.clips(df).where("doc_id < 4").collect())
    assert rows == [(i, *span, None) for i in (1, 2, 3) for span in ((0.0, 400.0), (400.0, 800.0))]
    assert [r["error"] for r in avi_media.clips(df).where("doc_id = 4").collect()] == ["no frames"]


def baseline(planes, sampling, restart=0, own_tables=True):
    """A baseline frame of planes of whole blocks, by the definition: DCT, quantiser 2, the usual tables."""
    from redactrail.llm import baseline_jpeg as B

    codes = {}
    for i in (0, 1):
        for kind, counts, symbols in ((0, B.DC_LENGTHS[i], B.DC_SYMBOLS), (1, B.AC_LENGTHS[i], B.AC_SYMBOLS[i])):
            code, values = 0, iter(bytes.fromhex(symbols))
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[kind, i, next(values)] = f"{code:0{n}b}"
                    code += 1
                code <<= 1
    h, v = sampling[0]
    rows, columns = planes[0].shape[0] // (8 * v), planes[0].shape[1] // (8 * h)
    out, bits, last = b"", "", [0] * len(planes)
    number = lambda x: "" if not x else f"{x if x > 0 else x + (1 << abs(x).bit_length()) - 1:0{abs(x).bit_length()}b}"

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return data

    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            last = [0] * len(planes)
        for c, (plane, (ch, cv)) in enumerate(zip(planes, sampling, strict=True)):
            for i in range(ch * cv):
                y, x = 8 * (unit // columns * cv + i // ch), 8 * (unit % columns * ch + i % ch)
                block = B.COSINES @ (plane[y : y + 8, x : x + 8] - 128.0) @ B.COSINES.T
                q = np.rint(block.ravel()[B.ZIGZAG] / 2).astype(int).tolist()
                d, last[c] = q[0] - last[c], q[0]
                bits += codes[0, min(c, 1), abs(d).bit_length()] + number(d)
                run = 0
                for k in range(1, 64):
                    if not any(q[k:]):
                        bits += codes[1, min(c, 1), 0]
                        break
                    if q[k] == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + codes[1, min(c, 1), 0xF0], run - 16
                    bits, run = bits + codes[1, min(c, 1), run << 4 | abs(q[k]).bit_length()] + number(q[k]), 0
    out += flush()
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([2] * 64)
    if restart:
        head += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    if own_tables:
        for i in (0, 1):
            for kind, counts, symbols in ((0, B.DC_LENGTHS[i], B.DC_SYMBOLS), (1, B.AC_LENGTHS[i], B.AC_SYMBOLS[i])):
                body = bytes([kind << 4 | i, *counts]) + bytes.fromhex(symbols)
                head += b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body
    parts = b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(sampling))
    head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + len(parts), 8, *planes[0].shape, len(planes)) + parts
    scan = b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(len(planes)))
    return head + b"\xff\xda" + struct.pack(">HB", 6 + len(scan), len(planes)) + scan + b"\0\x3f\0" + out + b"\xff\xd9"


def test_baseline_frames(spark):
    from redactrail.llm.baseline_jpeg import ZIGZAG, luma

    assert ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and ZIGZAG[-1] == 63
    rng = np.random.default_rng(6)
    y = rng.integers(0, 256, (32, 48)).astype(float)
    for frame in (baseline([y], [(1, 1)]), baseline([y], [(1, 1)], restart=4, own_tables=False), baseline([y, y[:16, :24], y[16:, 24:]], [(2, 2), (1, 1), (1, 1)], restart=2)):
        assert np.abs(luma(frame) - y).max() <= 5
        with pytest.raises(ValueError, match="cut short"):
            luma(frame[: len(frame) // 2])
    film = [baseline([np.full((16, 16), level) + rng.integers(0, 3, (16, 16))], [(1, 1)]) for level in [30.0] * 20 + [200.0] * 20]
    rows = avi_media.clips(spark.createDataFrame([(1, avi_media.write_avi(film, 16, 16))], "doc_id long, media binary")).collect()
    assert [(r["first_frame"], r["n_frames"], r["error"]) for r in rows] == [(0, 20, None), (20, 20, None)]


# 10


def best(rows, is_query, k):
    out = {}
    for i, v in rows:
        if is_query(i):
            scored = [(-int(sum(a * b for a, b in zip(v, w, strict=False))), j) for j, w in rows if j != i]
            out[i] = [(j, -s) for s, j in sorted(set(scored))[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_top_k_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(voronoi_knn, "BLOCK", block)
    monkeypatch.setattr(voronoi_knn, "QUERIES", block // 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)] + [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.1, 0.2]) for i in range(60)]
    odd = [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (2004, []), (2005, [3.0, 1.0]), rows[3]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in [*rows, (2004, []), (2005, [3.0, 1.0])]]
    found = {}
    for r in voronoi_knn.top_k(df, lambda c: c % 20 == 0, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == best(whole, lambda i: i % 20 == 0, 5)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in voronoi_knn.top_k(df, lambda c: c == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert voronoi_knn.top_k(df.limit(0), lambda c: c == 0).collect() == []
    assert voronoi_knn.top_k(df.limit(1), lambda c: c == 0).collect() == []


# the pipeline, and all queries


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "stage")
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_pipeline_against_plain_steps(spark, documents, tmp_path):
    """Which documents stay, and their ids: scores one by one, links by brute force, passages by a search of the texts."""
    import corpus_pipeline
    import public_tokenizers
    from test_dedup import brute_force, edited, prose
    from tokenizers import Tokenizer

    passage = prose(80, 990)
    texts = [prose(150, i) for i in range(24)]
    texts += [edited(texts[i], 2, i) for i in range(4)] + [texts[5], texts[6]] + ["bad junk " + " ".join(["junk", "spam"] * 60) + f" {i} {prose(20, 700 + i)}" for i in range(16)]
    for i in (9, 15, 20):
        texts[i] = f"{prose(60, 800 + i)} {passage} {prose(60, 900 + i)}"
    texts.append(prose(3000, 5000))
    label = [int(not t.startswith("bad")) for t in texts]
    documents(texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, y in enumerate(label)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    df, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    model = quality.fit(df, labels)
    good = [i for i, t in enumerate(texts) if model.score(t) >= 0.3]
    assert good == [i for i, y in enumerate(label) if y]
    first = brute_force([texts[i] for i in good])
    kept = [good[i] for i, parent in enumerate(first) if i == parent]
    assert {r["doc_id"] for r in rows} == set(kept) and len(kept) == len(good) - 6
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in kept:
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        if i in (15, 20):  # the passage stays in 9, its ends of 70 bytes or so in all three
            assert len(ids) - 0.8 * len(library.encode(passage).ids) > sum(x[2] for x in own) >= len(ids) - len(library.encode(passage).ids) - 4
        else:
            assert [(x[1], x[3]) for x in own] == [(x[1], crc32(ids[x[1] : x[1] + x[2]].tobytes())) for x in own] and sum(x[2] for x in own) == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 2048 for a, b in zip([(None, 0, 0), *places], places, strict=False))


def test_pipeline_of_odd_rows(spark, documents, monkeypatch, tmp_path):
    import corpus_pipeline

    texts = [*ODD, "so many words that make a text " * 3]
    documents(texts, [*range(9), None, 3]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 8
    documents(["x"]).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    from redactrail.llm import queries

    names = queries.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_warc_revisits", "op10_voronoi_knn"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from redactrail.llm import queries

    with duckdb.connect() as con:
        for t in ("pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        df = queries.queries()[name](spark, SMALL)
        cursor = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        expected = cursor.fetchall()
    columns = sorted(df.columns)
    assert sorted(names) == columns
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(repr([r[names.index(c)] for c in columns]) for r in expected)
