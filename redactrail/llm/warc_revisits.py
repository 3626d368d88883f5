"""WARC: records from files, and not-modified revisits resolved to the responses they stand for.

`read_warc` turns the bytes of WARC files into records, `write_warc` records into files, `resolve` gives every revisit its
response, `canonical` is the canonical form of a URL as a column.

Files are read in stretches, compressed or not, and what is broken has a row with the reason in `error`: a record cut short
(its headers, no payload), headers without a length or an end, bytes that are no record, a compressed member that is cut
short or damaged. Reading goes on at the next record or member. Header fields that are repeated are joined with commas.

Resolution is an as-of join: of the full responses with the revisit's canonical URL, the latest before it (of equal times
the one of the larger record_id). Then validators are checked: an ETag that both have must be the same (weakly compared),
else a Last-Modified date that both have; a revisit that shares neither with the response is not resolved. A resolved
revisit has the response's headers, but those that a 304 response may update (UPDATED, RFC 9110) from the revisit, where it
has them. Payloads are never moved: the result names the response's record and its payload's digest.

At scale. Responses and revisits, without payloads, are sorted by URL and time in ranges; within a range one pass carries
the latest response along, so nothing is joined and no URL, however often captured, is gathered in one task. What a range
has to know from those before it, one response a range at most, goes through the driver.

Cases. Records with an error are left out by `resolve`. Null URLs and those without "://" are compared as they are, null matches nothing. Null times: never resolved and
never a target. Repeated rows: resolved each. A response at the same time as a revisit is not before it. Header names count
without case; null headers as none; null values as missing. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrail.llm.common import mapped, pick, shuffle_partitions, sorted_shards, written

#: Header fields that a not-modified response updates, and query parameters that don't name a resource.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"

_HEADERS = pa.map_(pa.string(), pa.string())

#: How a compressed member begins, bytes that are worked on at once, and payload bytes of a file that is written.
MEMBER, STRETCH, FILE = b"\x1f\x8b\x08", 1 << 20, 8 << 20
#: What follows every record.
RECORD_END = b"\r\n\r\n"


def canonical(url: Column) -> Column:
    """Scheme and "www." dropped, host in lower case, no default port, fragment, tracking parameters or slash at the end.

    Other parameters are sorted.
    """
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(rest, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))).otherwise(url)


def _headers(raw: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def _stretches(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The plain bytes of a file in stretches of about STRETCH, and why one ends too early."""
    if data[:2] != MEMBER[:2]:
        yield from ((data[at : at + STRETCH], None) for at in range(0, len(data), STRETCH))
        return
    at = 0
    while at < len(data):
        if data[at : at + 3] != MEMBER:
            found = data.find(MEMBER, at + 1)
            yield b"", "no compressed member here"
            at = found if found >= 0 else len(data)
            continue
        unzip, fed = zlib.decompressobj(31), at
        try:
            while not unzip.eof and (unzip.unconsumed_tail or fed < len(data)):
                part = unzip.unconsumed_tail or data[fed : fed + STRETCH]
                fed += 0 if unzip.unconsumed_tail else len(part)
                yield unzip.decompress(part, STRETCH), None
        except zlib.error:
            pass
        if unzip.eof:
            at = fed - len(unzip.unused_data)
        else:
            found = data.find(MEMBER, at + 1)
            yield b"", "a compressed member is cut short or damaged"
            at = found if found >= 0 else len(data)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file: WARC headers, HTTP status, HTTP headers, payload; error: why one isn't whole."""
    held = bytearray()
    for part, error in _stretches(data):
        held += part
        yield from _whole(held, error is not None)
        if error:
            yield _broken(error)
    yield from _whole(held, True)


def _broken(error: str, warc: dict[str, str] | None = None) -> dict:
    return {"warc": warc or {}, "status": None, "http": {}, "payload": None, "error": error}


def _whole(held: bytearray, last: bool) -> Iterator[dict]:
    """Takes whole records from the front of held; if nothing comes after (last), what is broken as well."""

    def skip(start: int) -> None:
        found = held.find(b"WARC/1.", start)
        del held[: found if found >= 0 else len(held) if last else max(0, len(held) - 6)]  # of a mark that may go on

    while True:
        at = 0
        while at < len(held) and held[at] in b"\r\n":
            at += 1
        del held[:at]
        if not held or not last and len(held) < 16:
            return
        if not held.startswith(b"WARC/"):
            yield _broken("no record here")
            skip(1)
            continue
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if not last and len(held) < STRETCH:
                return
            yield _broken("headers without an end")
            skip(1)
            continue
        own = _headers(bytes(held[:end]))
        length = own.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield _broken("no length", own)
            skip(end)
            continue
        stop = end + 4 + int(length)
        if stop + 4 > len(held) and not last:
            return
        if stop > len(held) or not RECORD_END.startswith(held[stop : stop + 4]):  # what should end it is elsewhere
            yield _broken("cut short", own)
            skip(end)
            continue
        body = bytes(held[end + 4 : stop])
        del held[:stop]
        record = _broken("", own) | {"payload": body, "error": None}
        if own.get("content-type", "").startswith("application/http") and body[:5] == b"HTTP/":
            head, _, record["payload"] = body.partition(b"\r\n\r\n")
            first, _, lines = head.partition(b"\r\n")
            status = first.split(b" ")[1:2]
            record |= {"status": int(status[0]) if status and status[0].isdigit() else None, "http": _headers(lines)}
        yield record


def read_warc(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(record_id, type, url, ts, status, headers, payload_sha256, payload, error) of all records of files, a binary each.

    record_id is the WARC-Record-ID; the time is WARC-Date. Null files have no records.
    """
    from hashlib import sha256

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for (data,) in each:
            for r in parse(bytes(data)) if data is not None else ():
                own, payload = r["warc"], r["payload"]
                digest = None if payload is None else sha256(payload).hexdigest()
                yield own.get("warc-record-id"), own.get("warc-type"), own.get("warc-target-uri"), own.get("warc-date"), r["status"], list(r["http"].items()), digest, payload, r["error"]

    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", _HEADERS), ("payload_sha256", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
    text = "record_id string, type string, url string, date string, status int, headers map<string,string>, payload_sha256 string, payload binary, error string"
    read = mapped(pick(files, content=content_col), rows, schema, text)
    return read.select("record_id", "type", "url", F.try_to_timestamp("date").alias("ts"), "status", "headers", "payload_sha256", "payload", "error")


def write_warc(records: DataFrame) -> DataFrame:
    """(content): WARC files of records (record_id, type, url, ts, status, headers, payload), one member a record.

    Values are strings but for ts (a timestamp), status and payload; headers is a map; what is null is left out. Line ends in
    a value become spaces. A file has about FILE bytes of payload at most, or one record.
    """
    line = lambda name, value: f"{name}: {' '.join(value.splitlines())}\r\n".encode() if value is not None else b""

    def member(record_id, kind, url, date, status, headers, payload) -> bytes:
        http = b"".join(line(k, v) for k, v in headers or ())
        body = f"HTTP/1.1 {status or 0} -\r\n".encode() + http + b"\r\n" + (payload or b"")
        head = line("WARC-Type", kind) + line("WARC-Record-ID", record_id) + line("WARC-Target-URI", url) + line("WARC-Date", date)
        whole = b"WARC/1.1\r\n" + head + line("Content-Type", "application/http") + line("Content-Length", str(len(body))) + b"\r\n" + body + b"\r\n\r\n"
        return gzip.compress(whole, 1, mtime=0)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for record in each:
            held.append(member(*record))
            size += len(record[-1] or b"")
            if size >= FILE:
                yield (b"".join(held),)
                held, size = [], 0
        if held:
            yield (b"".join(held),)

    date = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date")
    own = records.select("record_id", "type", "url", date, "status", "headers", "payload")
    return mapped(own, rows, pa.schema([("content", pa.binary())]), "content binary", flush=1)


def matching(revisit: dict[str, str], response: dict[str, str]) -> str:
    """How the validators of both agree: "etag", "last-modified", or the reason why not."""
    bare = lambda tag: tag.removeprefix("W/").strip()
    a, b = revisit.get("etag"), response.get("etag")
    if a and b:
        return "etag" if bare(a) == bare(b) else "etag differs"
    a, b = revisit.get("last-modified"), response.get("last-modified")
    if a and b:
        return "last-modified" if a == b else "last-modified differs"
    return "no validator"


def resolve(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(record_id, url, canonical_url, ts, resolved, reason, refers_to, payload_sha256, headers) of every revisit.

    records: record_id, type, url, ts, status, headers, payload_sha256; rows of type "revisit" are resolved, rows of type
    "response" with status 200 are full responses, others are left out. reason: the validator that agrees, or why there is
    no response; the last three columns are null then.
    """
    spark = records.sparkSession
    id_type = records.schema["record_id"].dataType
    if "error" in records.columns:
        records = records.where("error IS NULL")
    is_revisit = F.col("type") == "revisit"
    known = F.filter(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    headers = F.transform(known, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    events = pick(records, record_id="record_id", type="type", url="url", ts="ts", status="status", headers="headers", payload_sha256="payload_sha256")
    events = events.where(is_revisit | ((F.col("type") == "response") & (F.col("status") == 200)))
    events = events.select(canonical(F.col("url")).alias("canon"), "ts", is_revisit.alias("revisit"), "record_id", "url", headers.alias("headers"), "payload_sha256")
    # at equal times revisits come first, for a response must be earlier
    ordered = sorted_shards(events.withColumn("rank", (~F.col("revisit")).cast("int")), ["canon", "ts", "rank", "record_id"], partitions or shuffle_partitions(spark))
    placed = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "captures")
    full = placed.where("NOT revisit AND canon IS NOT NULL AND ts IS NOT NULL")
    response = F.struct("canon", "record_id", "payload_sha256", F.col("headers"))
    tails = {r["part"]: r["last"] for r in full.groupBy("part").agg(F.max_by(response, "place").alias("last")).collect()}  # a row for each range
    before, latest = {}, None
    for part in range(max(tails, default=-1) + 2):
        before[part] = latest
        latest = tails.get(part, latest)
    last_part = max(before)

    # each range again by itself and in its order: ranges are dealt by their number, not by what they hold
    again = placed.repartitionById(partitions or shuffle_partitions(spark), F.col("part")).sortWithinPartitions("part", "place")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        now, own = None, None
        for canon, ts, revisit, record_id, url, headers, digest, part in each:
            if part != own:
                own = part
                latest = before[min(part, last_part)]
                now = None if latest is None else (latest["canon"], latest["record_id"], latest["payload_sha256"], {h["key"]: h["value"] for h in latest["headers"]})
            fields = {h["key"]: h["value"] for h in headers}
            if not revisit:
                now = (canon, record_id, digest, fields) if canon is not None and ts is not None else now
                continue
            if canon is None or ts is None or now is None or now[0] != canon:
                yield record_id, url, canon, ts, False, "no earlier response", None, None, None
                continue
            how = matching(fields, now[3])
            if how not in ("etag", "last-modified"):
                yield record_id, url, canon, ts, False, how, None, None, None
                continue
            merged = now[3] | {k: v for k, v in fields.items() if k in UPDATED}
            yield record_id, url, canon, ts, True, how, now[1], now[2], sorted(merged.items())

    from pyspark.sql.pandas.types import to_arrow_type

    ts_type, key = events.schema["ts"].dataType, id_type.simpleString()
    schema = pa.schema([("record_id", to_arrow_type(id_type)), ("url", pa.string()), ("canonical_url", pa.string()), ("ts", to_arrow_type(ts_type)), ("resolved", pa.bool_()), ("reason", pa.string()), ("refers_to", to_arrow_type(id_type)), ("payload_sha256", pa.string()), ("headers", _HEADERS)])
    text = f"record_id {key}, url string, canonical_url string, ts {ts_type.simpleString()}, resolved boolean, reason string, refers_to {key}, payload_sha256 string, headers map<string,string>"
    columns = ["canon", "ts", "revisit", "record_id", "url", "headers", "payload_sha256", "part"]
    return mapped(again.select(*columns), rows, schema, text)


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a table of pages (page_id, url, html), which has none: two for each page.

    The page as a response, and later a not-modified revisit of its URL in another spelling. Times are seconds: responses
    at page_id modulo 1000, revisits at page_id * 7 modulo 2000; every 7th page has no ETag but a date, every 10th revisit
    a stale validator, every 13th none at all.
    """
    own = pick(pages, page_id="page_id", url="url", html="html").where("page_id IS NOT NULL")
    nth = lambda n: F.pmod("page_id", F.lit(n)) == 0
    when = lambda seconds: F.timestamp_seconds(seconds)
    named = lambda n: F.concat(F.lit("<urn:capture:"), n.cast("string"), F.lit(">"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # a page's validators depend on its URL, as a resource's do
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(canonical(F.col("url")), F.lit(""))), 1, 8), F.lit('"'))
    date = F.concat(F.lit("day "), F.substring(tag, 2, 2))
    etag = F.when(~nth(7), tag)
    response = own.select(
        named(F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("type"), "url", when(F.pmod("page_id", F.lit(1000))).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Last-Modified"), date, F.lit("Date"), F.lit("first")).alias("headers"), payload.alias("payload"),
    )
    stale = F.when(nth(10), F.concat(F.lit("W/"), F.lit('"stale"'))).otherwise(F.concat(F.lit("W/"), etag))
    revisit = own.select(
        named(F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), F.regexp_replace("url", "^https?://(www[.])?", "HTTPS://").alias("url"), when(F.pmod(F.col("page_id") * 7, F.lit(2000))).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), F.when(~nth(13), stale), F.lit("Last-Modified"), F.when(~nth(13), date), F.lit("Date"), F.lit("again"), F.lit("Content-Type"), F.lit("none")).alias("headers"), F.lit(None).cast("binary").alias("payload"),
    )
    return response.union(revisit)


def resolved_captures(pages: DataFrame) -> DataFrame:
    """captures() written as WARC files, read back and resolved; ids and times as numbers, the headers as one string."""
    files = write_warc(captures(pages))
    records = written(read_warc(files).drop("payload"), "records")
    found = resolve(records.withColumn("record_id", F.regexp_extract("record_id", "(-?[0-9]+)>", 1).cast("long")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(entries, "; ")).withColumn("ts", F.unix_seconds("ts"))


#: The same for DuckDB.
ORACLE_SQL = r"""
WITH pages_ AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
two AS (
  SELECT page_id, url, false AS revisit, page_id * 2 AS record_id, page_id % 1000 AS ts, sha256(html) AS sha FROM pages_
  UNION ALL
  SELECT page_id, regexp_replace(url, '^https?://(www[.])?', 'HTTPS://'), true, page_id * 2 + 1, page_id * 7 % 2000, NULL FROM pages_
),
cut AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM two
),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS kept
  FROM cut
),
named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE url END AS canon FROM parts
),
events AS (
  SELECT *, substr(md5(coalesce(canon, '')), 1, 8) AS tag FROM named
),
matched AS (
  SELECT r.*, (SELECT max(struct_pack(ts := f.ts, record_id := f.record_id)) FROM events f WHERE NOT f.revisit AND f.canon = r.canon AND f.ts < r.ts).record_id AS target
  FROM events r WHERE r.revisit
),
both_ AS (
  SELECT a.*, f.sha AS target_sha, f.page_id AS target_page, f.tag AS target_tag,
    CASE WHEN a.page_id % 13 = 0 THEN NULL WHEN a.page_id % 10 = 0 THEN 'stale' WHEN a.page_id % 7 = 0 THEN NULL ELSE a.tag END AS own_etag,
    CASE WHEN f.page_id % 7 = 0 THEN NULL ELSE f.tag END AS target_etag
  FROM matched a LEFT JOIN events f ON f.record_id = a.target AND NOT f.revisit
),
judged AS (
  SELECT *, CASE WHEN target IS NULL THEN 'no earlier response'
    WHEN own_etag IS NOT NULL AND target_etag IS NOT NULL THEN CASE WHEN own_etag = target_etag THEN 'etag' ELSE 'etag differs' END
    WHEN page_id % 13 = 0 THEN 'no validator'
    WHEN substr(tag, 1, 2) = substr(target_tag, 1, 2) THEN 'last-modified' ELSE 'last-modified differs' END AS reason
  FROM both_
)
SELECT record_id, url, canon AS canonical_url, ts, reason IN ('etag', 'last-modified') AS resolved, reason,
  CASE WHEN reason IN ('etag', 'last-modified') THEN target END AS refers_to,
  CASE WHEN reason IN ('etag', 'last-modified') THEN target_sha END AS payload_sha256,
  CASE WHEN reason IN ('etag', 'last-modified') THEN
    'content-type: text/html; date: again'
    || CASE WHEN own_etag = 'stale' THEN '; etag: W/"stale"' WHEN own_etag IS NOT NULL THEN '; etag: W/"' || own_etag || '"' WHEN target_etag IS NOT NULL THEN '; etag: "' || target_etag || '"' ELSE '' END
    || '; last-modified: day ' || substr(tag, 1, 2) END AS headers
FROM judged
"""
