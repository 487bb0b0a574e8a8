"""What a compiled class says of itself: its name and the class that encloses it. Names are never taken from paths."""

from __future__ import annotations

import struct
from typing import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.rules import is_unsafe

# Sizes of constant pool entries by tag, from the class file format.
_SIZES = {3: 4, 4: 4, 9: 4, 10: 4, 11: 4, 12: 4, 17: 4, 18: 4, 5: 8, 6: 8, 7: 2, 8: 2, 16: 2, 19: 2, 20: 2, 15: 3}
_TWO_SLOTS = (5, 6)


class ClassFormatError(ValueError):
    pass


def modified_utf8(raw: bytes) -> str:
    """Java's encoding: NUL in two bytes, supplementary characters as surrogate pairs in two times three."""
    if b"\xc0\x80" in raw:
        raw = raw.replace(b"\xc0\x80", b"\0")
    try:
        return raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError as e:
        raise ClassFormatError(f"a name is not modified UTF-8: {e}") from e


class Truncated(ClassFormatError):
    """The data ends too early: with more of it the class may be sound."""


class Header:
    """The constant pool and this_class; `at` is the place behind super_class."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        if data[:4] != b"\xca\xfe\xba\xbe":
            raise ClassFormatError("no class file magic")
        count, at, index = self.u2(8), 10, 1
        self.utf8: dict[int, tuple[int, int]] = {}
        self.classes: dict[int, int] = {}
        while index < count:
            tag = self.u1(at)
            if tag == 1:
                n = self.u2(at + 1)
                self.utf8[index] = at + 3, n
                at += 3 + n
            elif tag in _SIZES:
                if tag == 7:
                    self.classes[index] = self.u2(at + 1)
                at += 1 + _SIZES[tag]
            else:
                raise ClassFormatError(f"constant pool tag {tag}")
            index += 2 if tag in _TWO_SLOTS else 1
        self.at = at + 6
        self.name = self.class_name(self.u2(at + 2))
        if is_unsafe(self.name):
            raise ClassFormatError(f"unsafe class name {self.name!r}")

    def u1(self, at: int) -> int:
        if at >= len(self.data):
            raise Truncated("truncated")
        return self.data[at]

    def u2(self, at: int) -> int:
        if at + 2 > len(self.data):
            raise Truncated("truncated")
        return struct.unpack_from(">H", self.data, at)[0]

    def u4(self, at: int) -> int:
        if at + 4 > len(self.data):
            raise Truncated("truncated")
        return struct.unpack_from(">I", self.data, at)[0]

    def text(self, index: int) -> str:
        if index not in self.utf8:
            raise ClassFormatError(f"constant {index} is no text")
        at, n = self.utf8[index]
        if at + n > len(self.data):
            raise Truncated("truncated")
        return modified_utf8(self.data[at : at + n])

    def class_name(self, index: int) -> str:
        if index not in self.classes:
            raise ClassFormatError(f"constant {index} is no class")
        return self.text(self.classes[index])


def internal_name(data: bytes) -> str:
    return Header(data).name


def enclosing_class(data: bytes) -> str | None:
    """The class that EnclosingMethod or InnerClasses names; the last one that says so counts. A $ in the name says nothing."""
    h = Header(data)
    def attributes(at: int) -> Iterator[tuple[str, int, int]]:
        n = h.u2(at)
        at += 2
        for _ in range(n):
            size = h.u4(at + 2)
            yield h.text(h.u2(at)), at + 6, size
            at += 6 + size
        yield "", at, 0

    at = h.at + 2 + 2 * h.u2(h.at)  # behind super_class and the interfaces
    for _ in range(2):  # fields, methods: skipped without reading their bodies
        n = h.u2(at)
        at += 2
        for _ in range(n):
            at += 6
            for _, place, size in attributes(at):
                end = place + size
            at = end
    parent = None
    for name, place, size in attributes(at):
        if name == "EnclosingMethod":
            if size != 4:
                raise ClassFormatError("EnclosingMethod has a wrong size")
            parent = h.class_name(h.u2(place))
        elif name == "InnerClasses":
            n = h.u2(place)
            if size != 2 + 8 * n:
                raise ClassFormatError("InnerClasses has a wrong size")
            for k in range(n):
                inner, outer = h.u2(place + 2 + 8 * k), h.u2(place + 4 + 8 * k)
                if outer and h.class_name(inner) == h.name:
                    parent = h.class_name(outer)
    return parent


def parsed(content: Column) -> Column:
    """struct<name, parent, error> of a class file. Broken nesting information means no parent, not an error."""

    @F.pandas_udf("name string, parent string, error string")
    def udf(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in it:
            yield pd.DataFrame([parse(x) for x in rows], columns=["name", "parent", "error"], dtype=object)

    return udf(content)


def parse(data: bytes | None) -> tuple[str | None, str | None, str | None]:
    if data is None:
        return None, None, "no content"
    data = bytes(data)
    try:
        name = internal_name(data)
    except ClassFormatError as e:
        return None, None, str(e)
    try:
        return name, enclosing_class(data), None
    except ClassFormatError:
        return name, None, None
