"""Interleaved document sequences with media by digest.

``sequences`` parses HTML into an ordered array of items: texts, and media references with their captions (the
figure's caption, else the image's alternative text).  ``resolve`` joins the references with a media table by digest
and puts what it finds back at the same positions, so that positions and captions stay aligned; a reference that no
row resolves stays, with a null.  ``store_texts`` makes the media: a text's UTF-8 bytes, filled with spaces to whole
rows, as the 8-bit RGB samples of a 64 pixels wide portable pixmap (P6), and a page that refers to it by its digest.
``read_media`` reads stored pixmaps back and computes their features.

Null HTML has no items; broken HTML is read as far as it goes, a declaration that can't be read as a comment; text
outside of elements counts; scripts and styles don't; null texts are stored as one row of spaces; equal texts give equal
media, and of equal digests one row resolves all references; null media and what isn't a whole pixmap give nulls for all
but their size and digest; extra columns pass through, and new columns get underscores where a name is taken.  References
to one digest are dealt to ``SALTS`` places, so that a medium that many pages show is no task's load.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from riskweave.llm import store, vec

WIDTH = 64
UNIT = 3 * WIDTH
SALTS = 8
SCHEME = "sha256:"
ITEM = StructType([StructField("position", IntegerType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("media", StringType()), StructField("caption", StringType())])
_HEADER = re.compile(rb"P6\n(\d+) (\d+)\n255\n")
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr article section figure figcaption blockquote ul ol table nav header footer body br hr title".split())


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.caption = False

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind
            return self.parse_bogus_comment(i)

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.caption and self.figure is not None:
            for i in self.figure:
                self.items[i]["caption"] = text
        else:
            self.add("text", text, None, None)

    def add(self, kind, text, media, caption):
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "media": media, "caption": caption})

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS or tag in ("img", "video", "audio", "source"):
            self.flush()
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("img", "video", "audio", "source") and (src := dict(attrs).get("src")):
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.add("media", None, src, dict(attrs).get("alt"))

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figure":
            self.figure = None
        elif tag == "figcaption":
            self.caption = False

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def parse_items(html: str | None) -> list[dict]:
    """The ordered items of a page."""
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``items`` as the last column, in place of the HTML."""
    others = [c for c in pages.columns if c != html]
    names = [f"__{i}" for i in range(len(others))]
    inner = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(others, names)), F.col(html).alias("__html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            for low, high in vec.spans(vec.text_buffer(batch.column("__html"))[1]):
                part = batch.slice(low, high - low)
                items = [parse_items(x) for x in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(items, kind)], [*names, "__items"])

    schema = StructType([*inner.schema.fields[:-1], StructField("__items", ArrayType(ITEM))])
    return inner.mapInArrow(run, schema).toDF(*others, store.fresh(pages.select(*(F.col(f"`{c}`") for c in others)), "items"))


def references(pages: DataFrame) -> DataFrame:
    """A row for each media item of the last column: the page's columns, ``position``, ``media`` and ``caption``."""
    others = pages.columns[:-1]
    names = [f"__{i}" for i in range(len(others))]
    items = pages.toDF(*names, "__items").select(*names, F.explode(F.filter("__items", lambda x: x["kind"] == "media")).alias("__item"))
    taken = pages.select(*(F.col(f"`{c}`") for c in others))
    return items.select(*names, "__item.position", "__item.media", "__item.caption").toDF(*others, *(store.fresh(taken, c) for c in ("position", "media", "caption")))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """``refs``, whose column before the last names media, with the columns of ``media`` (by ``digest``, one row for each) at
    every reference; null where none is."""
    names, found = [f"__{i}" for i in range(len(refs.columns))], [c for c in media.columns if c != "digest"]
    inner = [f"__m{i}" for i in range(len(found))]
    once = media.where("digest is not null").groupBy("digest").agg(*(F.min_by(F.col(f"`{c}`"), F.xxhash64(*(F.col(f"`{f}`") for f in found))).alias(n) for c, n in zip(found, inner)))
    once = once.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = F.col(names[-2])
    keyed = refs.toDF(*names).withColumn("digest", F.when(at.startswith(SCHEME), F.substr(at, F.lit(len(SCHEME) + 1))))
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
    done = keyed.join(once, ["digest", "__salt"], "left").select(*names, "digest", *inner)
    out = [*refs.columns, store.fresh(refs, "digest")]
    for c in found:
        taken = {x.lower() for x in out}
        while c.lower() in taken:
            c = f"_{c}"
        out.append(c)
    return done.toDF(*out)


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For every row: ``key``, its page (``html``) and the ``media`` that the page refers to, with its ``digest`` and ``n_bytes``."""

    def run(batches):
        for whole in batches:
            for low, high in vec.spans(vec.text_buffer(whole.column(1))[1]):
                batch = whole.slice(low, high - low)
                pages, media, digests, sizes = [], [], [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = (t or "").encode()
                    rows = max(1, -(-len(raw) // UNIT))
                    media.append(b"P6\n%d %d\n255\n" % (WIDTH, rows) + raw.ljust(rows * UNIT))
                    digests.append(hashlib.sha256(media[-1]).hexdigest())
                    sizes.append(len(raw))
                    pages.append(f'<article><h1>Document {k}</h1><figure><img src="{SCHEME}{digests[-1]}" alt="text"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary()), pa.array(sizes, pa.int64())], ["key", "html", "digest", "media", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, html string, digest string, media binary, n_bytes long")


def read_media(media: DataFrame) -> DataFrame:
    """Of every stored pixmap: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The feature is the size and, for each colour, the sum of its samples."""

    def features(digest, stored):
        head = _HEADER.match(stored or b"")
        width, height = (int(head[1]), int(head[2])) if head else (0, 0)
        own = (len(stored), hashlib.sha256(stored).hexdigest()) if stored is not None else (None, None)
        if not width * height or len(stored) < head.end() + 3 * width * height:
            return digest, None, None, None, *own, None
        samples = np.frombuffer(stored, np.uint8, 3 * width * height, head.end())
        payload = samples.tobytes()
        sums = samples.reshape(-1, 3).sum(0, dtype=np.int64)
        return digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, f"{width}x{height}:{sums[0]}:{sums[1]}:{sums[2]}"

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for low, high in vec.spans(vec.text_buffer(whole.column(1))[1]):
                batch = whole.slice(low, high - low)
                columns = list(zip(*map(features, batch.column(0).to_pylist(), batch.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
