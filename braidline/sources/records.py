"""The binary record format of adapter blobs in integration flows, and their readers."""

from __future__ import annotations

import base64
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed values of the format: the first bytes, the class named first, and the tags of values.
PREAMBLE = bytes([0x0B, 0x04, 0x00, 0x00, 0x00, 0x01, 0x05, 0x01])
CLASS_NAME = "com.wm.data.ISMemDataImpl"
NULL, INT32, BOOLEAN, STRING, STRINGS, RECORD, RECORDS = 1, 2, 3, 4, 5, 6, 7


class BadRecord(ValueError):
    """Says at which byte reading failed."""

    def __init__(self, what: str, at: int):
        super().__init__(f"byte {at}: {what}")
        self.at = at


def _string(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    if len(raw) > 2 * 0xFFFF:
        raise ValueError("a string is too long")
    return struct.pack("<BH", STRING, len(raw) // 2) + raw


def _fields(record: dict) -> bytes:
    return struct.pack("<I", len(record)) + b"".join(_string(str(k)) + _packed(v) for k, v in record.items())


def _packed(value) -> bytes:
    match value:
        case None:
            return struct.pack("<B", NULL)
        case bool():
            return struct.pack("<BB", BOOLEAN, value)
        case int():
            return struct.pack("<Bi", INT32, value)
        case str():
            return _string(value)
        case dict():
            return struct.pack("<B", RECORD) + _fields(value)
        case [dict(), *_]:
            return struct.pack("<BI", RECORDS, len(value)) + b"".join(map(_fields, value))
        case list() | tuple():
            return struct.pack("<BI", STRINGS, len(value)) + b"".join(_packed(None if v is None else str(v)) for v in value)
    raise TypeError(f"no tag for {type(value).__name__}")


def encode(record: dict, class_name: str = CLASS_NAME) -> bytes:
    return PREAMBLE + _string(class_name) + _fields(record)


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def read(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.raw):
            raise BadRecord(f"{size} bytes are wanted, {len(self.raw) - self.at} are left", self.at)
        (got,) = struct.unpack_from(form, self.raw, self.at)
        self.at += size
        return got

    def text(self) -> str:
        size = 2 * self.read("<H")
        if self.at + size > len(self.raw):
            raise BadRecord("a string goes past the end", self.at)
        self.at += size
        return self.raw[self.at - size : self.at].decode("utf-16-le")

    def tagged_text(self, or_null: bool = False) -> str | None:
        at, tag = self.at, self.read("<B")
        if or_null and tag == NULL:
            return None
        if tag != STRING:
            raise BadRecord(f"tag {tag} where a string is wanted", at)
        return self.text()

    def fields(self) -> dict:
        return {self.tagged_text(): self.value() for _ in range(self.read("<I"))}

    def value(self):
        at, tag = self.at, self.read("<B")
        if tag == NULL:
            return None
        if tag == INT32:
            return self.read("<i")
        if tag == BOOLEAN:
            return self.read("<B") != 0
        if tag == STRING:
            return self.text()
        if tag == STRINGS:
            return [self.tagged_text(or_null=True) for _ in range(self.read("<I"))]
        if tag == RECORD:
            return self.fields()
        if tag == RECORDS:
            return [self.fields() for _ in range(self.read("<I"))]
        raise BadRecord(f"unknown tag {tag}", at)


def decode(raw: bytes) -> tuple[dict, str]:
    """(record, class name); trailing bytes are an error."""
    if not raw.startswith(PREAMBLE):
        raise BadRecord("the first bytes are others", 0)
    reader = _Bytes(raw)
    reader.at = len(PREAMBLE)
    name = reader.tagged_text()
    record = reader.fields()
    if reader.at != len(raw):
        raise BadRecord(f"{len(raw) - reader.at} bytes are left over", reader.at)
    return record, name


def decode_blobs(nodes: DataFrame, blob: str = "blob") -> DataFrame:
    """The input with record (JSON) and error beside each base64 blob."""
    shape = StructType([*nodes.schema.fields, StructField("record", StringType()), StructField("error", StringType())])
    place = nodes.columns.index(blob)

    def run(batches):
        for batch in batches:
            records, errors = [], []
            for text in batch.column(place).to_pylist():
                try:
                    records.append(json.dumps(decode(base64.b64decode(text, validate=True))[0], ensure_ascii=False) if text is not None else None)
                    errors.append(None)
                except ValueError as e:
                    records.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(records, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "record", "error"])

    return nodes.mapInArrow(run, shape)


def encode_blobs(records: DataFrame, column: str = "json") -> DataFrame:
    """The input with a base64 blob of each JSON record."""
    place = records.columns.index(column)

    def run(batches):
        for batch in batches:
            made = [None if x is None else base64.b64encode(encode(json.loads(x))).decode() for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "blob"])

    return records.mapInArrow(run, StructType([*records.schema.fields, StructField("blob", StringType())]))


def blobs_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """The base64 values named IRTNODE_PROPERTY of XML nodes, one a row."""
    return documents.withColumn("blob", F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?s)<value name="IRTNODE_PROPERTY">\s*([A-Za-z0-9+/=\s]*?)\s*</value>'), 1))).withColumn("blob", F.regexp_replace("blob", r"\s", ""))
