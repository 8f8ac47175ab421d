"""WARC derivatives: metadata and conversion records of responses.

Each response gives two records that refer to it and name each other: ``metadata``
(application/warc-fields: title, language, links, size, the conversion's id) and
``conversion`` (text/plain). Both keep the target, the date, the source's own WARC and HTTP
headers and the digests that it declares, which are compared with its bytes; their own
digests are SHA-1 in base 32. Chunked and compressed payloads are unpacked for the text. A
payload that isn't text has metadata only.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html as html_lib
import re
import uuid
import zlib
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text_arrow import chunks
from tessera.runtime import read_table, ship_package

DROPPED = re.compile(r"(?i)<!--|<!doctype|<(script|style|template|noscript|svg|head)\b")
BREAK = re.compile(r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|table|tr|article|section|header|footer|nav|aside|main|blockquote|pre|body|html|title|form|hr|dl|dt|dd|figure)\b[^>]*>")
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v ]+")
TITLE, TITLE_END = re.compile(r"(?i)<title[^>]*>"), re.compile(r"(?i)</title\s*>")
LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""")
LINK = re.compile(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based id: reruns make the same record the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def strip(markup: str) -> str:
    """The page without comments, scripts, styles and the head. An element that is never closed
    stays. Each kind of end is looked for once past its last one, so time grows with length."""
    out, at, start, never = [], 0, 0, set()
    ends: dict[str, re.Pattern] = {}
    while (m := DROPPED.search(markup, start)) is not None:
        kind = (m[1] or m[0]).lower()
        if kind not in ends:
            ends[kind] = re.compile({"<!--": "-->", "<!doctype": ">"}.get(kind, rf"</{kind}\s*>"), re.I)
        end = None if kind in never else ends[kind].search(markup, m.end())
        if end is None:
            never.add(kind)
            start = m.end()
            continue
        out += [markup[at : m.start()], " "]
        at = start = end.end()
    return "".join(out) + markup[at:]


def plain_text(markup: str) -> str:
    """Text of a page: scripts, styles, comments and the head go, blocks end lines."""
    t = BREAK.sub("\n", strip(markup))
    t = html_lib.unescape(TAG.sub("", t))
    lines = (BLANKS.sub(" ", x).strip() for x in t.split("\n"))
    return "\n".join(x for x in lines if x)


def header(head: bytes, name: str) -> str:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("latin-1").strip() if m else ""


def unpacked(head: bytes, body: bytes) -> bytes | None:
    """The payload without chunks and compression; None where they can't be undone."""
    try:
        if "chunked" in header(head, "transfer-encoding").lower():
            out, at = [], 0
            while True:
                end = body.index(b"\n", at)
                size = int(body[at:end].split(b";")[0], 16)
                if not size:
                    break
                out.append(body[end + 1 : end + 1 + size])
                at = body.index(b"\n", end + 1 + size) + 1
            body = b"".join(out)
        for coding in reversed([x.strip() for x in header(head, "content-encoding").lower().split(",") if x.strip()]):
            if coding in ("gzip", "x-gzip"):
                body = zlib.decompress(body, 47)
            elif coding == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
            elif coding != "identity":
                return None
        return body
    except (ValueError, zlib.error):
        return None


def declared(digest_text: str, data: bytes) -> bool | None:
    """Whether a digest in a header is that of the bytes; None for none or an unknown kind."""
    name, _, value = digest_text.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    raw = hashlib.new(name, data).digest()
    return value.strip().lower() in (raw.hex(), base64.b32encode(raw).decode().lower(), base64.b32encode(raw).decode().rstrip("=").lower(), binascii.b2a_base64(raw, newline=False).decode().lower())


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; a block without a status line is all payload."""
    if block.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            head, found, body = block.partition(gap)
            if found:
                return head, body
        return block, b""
    return b"", block


def charset(head: bytes) -> str:
    m = re.search(rb"(?im)^content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9_-]+)", head)
    return m[1].decode() if m else "utf-8"


def derive(rid: str, uri: str | None, date: str | None, block: bytes, source: str = "") -> list[dict]:
    """The records of one response; ``source`` are its own WARC headers, as text."""
    head, body = split_http(block)
    given = source.encode("utf-8", "replace")
    block_digest, payload_digest = header(given, "WARC-Block-Digest"), header(given, "WARC-Payload-Digest")
    verdicts = [x for x in (declared(block_digest, block), declared(payload_digest, body)) if x is not None]
    kind_of = header(head, "content-type").split(";")[0].strip().lower()
    data = unpacked(head, body)
    readable = data is not None and (not kind_of or kind_of.startswith("text/") or "html" in kind_of or "xml" in kind_of or kind_of == "application/json")
    markup = ""
    if readable:
        try:
            markup = data.decode(charset(head), "replace")
        except LookupError:
            markup = data.decode("utf-8", "replace")
    page = not kind_of or "html" in kind_of or "xml" in kind_of
    text = plain_text(markup) if page else markup
    title, language, links = None, None, []
    if page:
        start = TITLE.search(markup)
        end = TITLE_END.search(markup, start.end()) if start else None
        title = " ".join(html_lib.unescape(markup[start.end() : end.start()]).split()) if end else None
        found = LANG.search(markup)
        language = found[1] if found else None
        for a, b, c in LINK.findall(strip(markup)):
            try:
                links.append(urljoin(uri or "", html_lib.unescape(a or b or c).strip()).replace("\r", "").replace("\n", ""))
            except ValueError:
                continue
    ids = {k: record_id(rid, k) for k in ("metadata", "conversion")}
    fields = [("title", title), ("language", language), ("payload-type", kind_of), ("payload-length", str(len(body))), ("source-digests", "" if not verdicts else "match" if all(verdicts) else "differ"),
              ("conversion", ids["conversion"] if readable else None), *(("outlink", x) for x in links)]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    made = [("metadata", "application/warc-fields", meta)] + [("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))] * readable
    out = []
    for kind, content, bytes_ in made:
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", rid), ("WARC-Target-URI", uri), ("WARC-Date", date),
                   ("WARC-Block-Digest", digest(bytes_)), ("WARC-Source-Block-Digest", block_digest or digest(block)), ("WARC-Source-Payload-Digest", payload_digest or digest(body)),
                   ("WARC-Metadata-ID", ids["metadata"] if kind == "conversion" else None), ("Content-Type", content), ("Content-Length", str(len(bytes_)))]
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": rid, "target_uri": uri, "date": date, "content_type": content,
                    "content_length": len(bytes_), "block_digest": digest(bytes_), "source_block_digest": block_digest or digest(block), "source_payload_digest": payload_digest or digest(body),
                    "source_digests_match": all(verdicts) if verdicts else None, "source_headers": head.decode("latin-1"), "source_warc_headers": source,
                    "warc_headers": "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None), "block": bytes_.decode("utf-8", "replace")})
    return out


def serialise(warc_headers: str, block: str) -> bytes:
    return warc_headers.encode() + b"\r\n" + block.encode() + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records of uncompressed WARC bytes, by their lengths."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        out.append((headers, data[start : start + size]))
        at = start + size + 4
    return out


COLUMNS = [("record_type", "string"), ("record_id", "string"), ("refers_to", "string"), ("target_uri", "string"), ("date", "string"), ("content_type", "string"),
           ("content_length", "long"), ("block_digest", "string"), ("source_block_digest", "string"), ("source_payload_digest", "string"),
           ("source_digests_match", "boolean"), ("source_headers", "string"), ("source_warc_headers", "string"), ("warc_headers", "string"), ("block", "string")]


def build_derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for each response (``key``, record_id, target_uri, date, block as binary or
    string and, if there are, its WARC headers as ``warc_headers``), one for a payload that
    isn't text. A null block is an empty one; a null record id is made from target and key; a
    null target or date leaves its header out. Equal responses give equal records, and an
    empty table none. Other columns aren't read. Rows are worked on alone and whole."""
    ship_package(responses.sparkSession)
    kind = responses.schema[key].dataType.simpleString()
    picked = responses.select(responses[key].alias("i"), responses["record_id"].alias("r"), responses["target_uri"].alias("u"), responses["date"].alias("d"),
                              responses["block"].cast("binary").alias("b"), (responses["warc_headers"] if "warc_headers" in responses.columns else F.lit(None).cast("string")).alias("h"))

    def run(batches):
        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        for batch in batches:
            for part, blocks in chunks(batch, "b"):
                ids, rows = [], []
                for i, r, u, d, h, b in zip(*(part.column(c).to_pylist() for c in ("i", "r", "u", "d", "h")), blocks):
                    made = derive(r or record_id(u or "", str(i)), u, d, b or b"", h or "")
                    rows += made
                    ids += [i] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column("i").type), *(pa.array([x[n] for x in rows], types[t]) for n, t in COLUMNS)],
                                                 names=["i", *(n for n, _ in COLUMNS)])

    return picked.mapInArrow(run, f"i {kind}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS)).withColumnRenamed("i", key)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: an HTTP head and the page's bytes, and WARC headers with
    the payload's digest. Pages have no time of their own: ``date`` stands for it."""
    body = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("\n", F.col("url"), F.col("page_id").cast("string"))), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
                        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head.cast("binary"), body).alias("block"),
                        F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\n")).alias("warc_headers"))


def op3_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return build_derivatives(responses_of_pages(read_table(spark, sf_dir, "pages")))
