"""Series definitions: a text grammar of name, tags and typed, encoded, compressed columns, and their Spark schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

VARIABLE = "var"
_WIDE = ("None", "Delta", "DeltaDelta", "Xor")
_REAL = ("None", "Xor", "Dfcm")

#: For each type its bit sizes with their encodings (the first of each is the default), and aliases.
TYPES: dict[str, dict[str, tuple[str, ...]]] = {
    "datetime": {"64": ("DeltaDelta", "None", "Delta", "Xor")},
    "timespan": {"64": ("DeltaDelta", "None", "Delta", "Xor")},
    "decimal": {"128": ("None",)},
    "double": {"64": ("Dfcm", "None", "Xor")},
    "float": {"32": ("Dfcm", "None", "Xor")},
    "uint64": {"64": ("Xor", "None", "Delta", "DeltaDelta")},
    "uint32": {"32": ("Xor", "None", "Delta", "DeltaDelta")},
    "uint16": {"16": ("Xor", "None", "Delta", "DeltaDelta")},
    "uint8": {"8": _WIDE, "1": ("None",), "2": ("None",), "4": ("None",)},
    "int64": {"64": ("Xor", "None", "Delta", "DeltaDelta")},
    "int32": {"32": ("Xor", "None", "Delta", "DeltaDelta")},
    "int16": {"16": ("Xor", "None", "Delta", "DeltaDelta")},
    "int8": {"8": _WIDE, "1": ("None",), "2": ("None",), "4": ("None",)},
    "boolean": {"1": ("None",)},
    "string": {VARIABLE: ("None",)},
    "byte[]": {VARIABLE: ("None",)},
    "stream": {VARIABLE: ("None",)},
}
ALIASES = {
    "ulong": "uint64", "uint": "uint32", "ushort": "uint16", "byte": "uint8", "long": "int64", "int": "int32", "short": "int16", "sbyte": "int8",
    "bool": "boolean", "single": "float", "bytearray": "byte[]",
}
ENCODINGS = {"none": "None", "delta": "Delta", "deltadelta": "DeltaDelta", "xor": "Xor", "dfcm": "Dfcm"}
COMPRESSIONS = {"nocompress": "nocompress", "nocompression": "nocompress", "none": "nocompress", "zlib": "zlib", "gzip": "zlib", "lz4": "lz4", "zstd": "zstd"}
LEVELS = {"nocompress": "", "zlib": "fastest", "lz4": "fast", "zstd": "3"}
DEFAULT_COMPRESSION = "zstd"

SPARK_TYPES: dict[str, T.DataType] = {
    "datetime": T.TimestampNTZType(), "timespan": T.LongType(), "decimal": T.DecimalType(38, 10), "double": T.DoubleType(), "float": T.FloatType(),
    "uint64": T.DecimalType(20, 0), "uint32": T.LongType(), "uint16": T.IntegerType(), "uint8": T.ShortType(),
    "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(),
    "boolean": T.BooleanType(), "string": T.StringType(), "byte[]": T.BinaryType(), "stream": T.BinaryType(),
}


def type_name(text: str) -> str:
    low = text.lower()
    name = ALIASES.get(low, low)
    if name not in TYPES:
        raise ValueError(f"unknown type {text!r}")
    return name


@dataclass(frozen=True)
class Compression:
    algorithm: str = DEFAULT_COMPRESSION
    level: str = LEVELS[DEFAULT_COMPRESSION]

    @staticmethod
    def parse(text: str) -> Compression:
        name, _, rest = text.partition(".")
        algorithm = COMPRESSIONS.get(name.strip().lower())
        if algorithm is None:
            raise ValueError(f"unknown compression {text!r}")
        level = rest.lower().removeprefix("level=") if rest else LEVELS[algorithm]
        if rest and not level or algorithm == "nocompress" and level or algorithm == "zstd" and not level.lstrip("-").isdigit():
            raise ValueError(f"bad level in {text!r}")
        return Compression(algorithm, level)

    def __str__(self) -> str:
        return f"{self.algorithm}.level={self.level}" if self.level else self.algorithm


@dataclass(frozen=True)
class ColumnDef:
    """One column. Missing parts take the defaults of the type and bit size."""

    name: str | None
    type: str
    bits: str = ""
    encoding: str = ""
    compression: Compression = field(default_factory=Compression)

    def __post_init__(self):
        kind = type_name(self.type)
        bits = str(self.bits or next(iter(TYPES[kind]))).lower()
        bits = VARIABLE if bits in ("var", "null") or bits.lstrip("-").isdigit() and int(bits) <= 0 else bits
        if bits not in TYPES[kind]:
            raise ValueError(f"{kind} has no bit size {bits}")
        encoding = ENCODINGS.get((self.encoding or TYPES[kind][bits][0]).lower())
        if encoding not in TYPES[kind][bits]:
            raise ValueError(f"{kind} of {bits} bits has no encoding {self.encoding}")
        for k, v in (("type", kind), ("bits", bits), ("encoding", encoding)):
            object.__setattr__(self, k, v)

    @staticmethod
    def parse(line: str) -> ColumnDef:
        parts = line.split(" ")
        if len(parts) > 2 or not parts[-1]:
            raise ValueError(f"a column is '[name] type', not {line!r}")
        kind, *rest = parts[-1].split(",")
        if len(rest) > 3:
            raise ValueError(f"too many parts in {line!r}")
        bits, encoding, compression = [*rest, "", "", ""][:3]
        return ColumnDef(parts[0] if len(parts) == 2 else None, kind, bits, encoding, Compression.parse(compression) if compression else Compression())

    def __str__(self) -> str:
        text = f"{self.type},{self.bits},{self.encoding},{self.compression}"
        return f"{self.name} {text}" if self.name else text

    def retyped(self, kind: str) -> ColumnDef:
        """Another type takes its own default bits and encoding; the compression stays."""
        return ColumnDef(self.name, kind, compression=self.compression)


@dataclass(frozen=True)
class Series:
    columns: tuple[ColumnDef, ...]
    name: str | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        names = [c.name for c in self.columns if c.name is not None]
        if not self.columns or len(set(names)) < len(names):
            raise ValueError("a series has columns, with names of their own")

    @staticmethod
    def parse(text: str) -> Series:
        head, *lines = text.replace("\r\n", "\n").split("\n")
        lines = [x for x in lines if x]
        if "  " in head:
            raise ValueError("two spaces in the first line")
        name, tags = None, {}
        for k, token in enumerate(head.split(" ") if head else []):
            if "=" not in token and k == 0 and token:
                name = token
                continue
            key, sep, value = token.partition("=")
            if not sep or not key or not value or "=" in value or key in tags:
                raise ValueError(f"bad tag {token!r}")
            tags[key] = value
        return Series(tuple(ColumnDef.parse(x) for x in lines), name, tags)

    def __str__(self) -> str:
        head = " ".join([*([self.name] if self.name else []), *(f"{k}={v}" for k, v in self.tags.items())])
        return "\n".join([head, *map(str, self.columns)])

    def spark_schema(self) -> T.StructType:
        """Fixed-size types aren't nullable; unnamed columns are _c0, _c1, ..."""
        out = []
        for i, c in enumerate(self.columns):
            out.append(T.StructField(c.name or f"_c{i}", SPARK_TYPES[c.type], c.bits == VARIABLE, {"type": c.type, "bit_size": c.bits, "encoding": c.encoding, "compression": str(c.compression)}))
        return T.StructType(out)

    def recompressed(self, compression: str | None = None) -> Series:
        setting = Compression.parse(compression or "nocompress")
        return Series(tuple(ColumnDef(c.name, c.type, c.bits, c.encoding, setting) for c in self.columns), self.name, self.tags)


def definition_matrix() -> list[tuple[str, str, str, str]]:
    """(type, bits, encoding, compression) of every legal definition."""
    return [(t, b, e, c) for t, sizes in TYPES.items() for b, encodings in sizes.items() for e in encodings for c in LEVELS]
