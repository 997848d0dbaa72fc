"""Media columns: progressive JPEG images, stored as a binary column and decoded to full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, jpeg
from .tokens import text_runs

BLOCK = 64


def feature_of(rgb: np.ndarray) -> str:
    """Size, the sum of each channel and the counts of eight equal ranges of its values."""
    flat = rgb.reshape(-1, 3)
    parts = []
    for c in range(3):
        counts = np.bincount(flat[:, c], minlength=256)
        parts.append(f"{int(counts @ np.arange(256))}:{'/'.join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))}")
    return f"{rgb.shape[0]}x{rgb.shape[1]}x3;{';'.join(parts)}"


def _decode(with_tensor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "media"]
            for i, item in enumerate(batch.column("media")):
                height = width = rgb = error = None
                try:
                    tensor = jpeg.to_rgb(jpeg.decode_coefficients(item.as_py() or b""))
                    height, width = tensor.shape[:2]
                    rgb = tensor.tobytes() if with_tensor else None
                    feature = feature_of(tensor)
                except (jpeg.BadImage, IndexError, KeyError, AttributeError, ValueError) as e:
                    feature, error = None, f"{type(e).__name__}: {e}"
                out = [pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([rgb], pa.binary()), pa.array([feature], pa.string()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, 1) for n in keep), *out], names=[*keep, "height", "width", "rgb", "feature", "error"])

    return run


def decode_media(images: DataFrame, with_tensor: bool = True) -> DataFrame:
    """images(media, ...): height, width, rgb (row by row, three bytes a pixel), feature and error in place of media.

    Null, empty or damaged media and other formats give nulls and say why in `error`; other columns are kept, but columns
    with those five names are replaced. One image at a time is held, so memory follows the largest image.
    """
    images = images.drop("height", "width", "rgb", "feature", "error")
    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    kept = [f for f in images.schema.fields if f.name != "media"]
    more = [StructField(n, t) for n, t in (("height", IntegerType()), ("width", IntegerType()), ("rgb", BinaryType()), ("feature", StringType()), ("error", StringType()))]
    return images.mapInArrow(_decode(with_tensor), StructType(kept + more))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_runs(batch.column("text")):
            n_bytes, media = [], []
            for text in batch.column("text").slice(a, b - a).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                n_bytes.append(len(raw))
                media.append(jpeg.encode_payload(raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def payload_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text (null: empty) as UTF-8, padded by zeros to a positive multiple of 64
    bytes and stored without loss as the coefficients of a progressive JPEG."""
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item in batch.column("media"):
            media = item.as_py()
            frame = jpeg.decode_coefficients(media)
            payload = jpeg.payload_of(frame)
            rows.append(
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(jpeg.to_rgb(frame)))
            )
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", *names])


def payload_digest(docs: DataFrame) -> DataFrame:
    """Store the texts as a media column in the shared folder, read it back and describe each image and its payload."""
    stored = common.store(payload_images(docs), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = common.store(stored.mapInArrow(_digest, schema), "media-digest")
    common.drop(stored)
    return found
