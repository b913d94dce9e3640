"""Media columns: payloads stored as progressive JPEG, read back and described.

A null text is empty. A payload is a text's UTF-8 bytes and zero bytes up to a positive
multiple of 64. Equal texts give equal streams and features; repeated rows and null ids are
stored each. Very long texts are coded in chunks of blocks. One narrow pass, no shuffle.
Empty tables give no rows. Other columns aren't read, so their names can't clash. Payload
streams hold luma alone; colour streams, with chroma upsampled, are read by the same decoder.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm import jpeg
from boxloom.llm.common import sliced

BLOCK = 64


def _stored(batches):
    for batch in batches:
        sizes, media = [], []
        for text in batch.column(1):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            sizes.append(len(data))
            media.append(jpeg.write_payload(data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def feature_of(tensor) -> str:
    """Size, mean of each channel, and the check sum of the whole tensor."""
    means = tensor.reshape(-1, 3).sum(axis=0, dtype="int64") / (tensor.shape[0] * tensor.shape[1])
    return f"{tensor.shape[1]}x{tensor.shape[0]} rgb {means[0]:.3f} {means[1]:.3f} {means[2]:.3f} crc {zlib.crc32(tensor.tobytes()):08x}"


def _described(batches):
    for batch in batches:
        rows = []
        for value in batch.column(2):
            media = value.as_buffer().to_pybytes()
            image = jpeg.read(media)
            back = jpeg.payload_of(image)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(jpeg.rgb(image))))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "n_bytes", *names])


def _tensors(batches):
    for batch in batches:
        shapes, data = [], []
        for value in batch.column(1):
            tensor = jpeg.rgb(jpeg.read(value.as_buffer().to_pybytes()))
            shapes.append(tensor.shape)
            data.append(tensor.tobytes())
        sizes = [pa.array([s[i] for s in shapes], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(data, pa.binary())], ["id", "height", "width", "rgb"])


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text as a progressive JPEG stream."""
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(sliced(_stored, 200), "id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Decodes stored streams: payload sums, media sums and a feature of the RGB tensor."""
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(sliced(_described, 200), schema)


def tensors(media: DataFrame) -> DataFrame:
    """id, height, width and rgb: the full-resolution tensor of each stored stream (id, media), row by row, three bytes a pixel."""
    return media.select("id", "media").mapInArrow(sliced(_tensors, 50), "id long, height int, width int, rgb binary")
