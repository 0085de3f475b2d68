"""The EXIF orientation of picture files."""

from __future__ import annotations

import struct

#: EXIF's tag of the orientation, and for each orientation the turn that makes a picture upright.
ORIENTATION_TAG = 0x0112
UPRIGHT = {
    1: lambda p: p,
    2: lambda p: p[:, ::-1],
    3: lambda p: p[::-1, ::-1],
    4: lambda p: p[::-1],
    5: lambda p: p.swapaxes(0, 1),
    6: lambda p: p[::-1].swapaxes(0, 1),
    7: lambda p: p[::-1, ::-1].swapaxes(0, 1),
    8: lambda p: p[:, ::-1].swapaxes(0, 1),
}


def exif_block(content: bytes) -> bytes:
    """The TIFF structure with a JPEG's or PNG's EXIF fields; empty if there is none."""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
            (size,) = struct.unpack_from(">H", content, at + 2)
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            at += 2 + size
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            (size,) = struct.unpack_from(">I", content, at)
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return b""


def orientation(content: bytes) -> int:
    """The EXIF orientation of a picture file, 1 to 8; 1 where it isn't told or makes no sense."""
    block = exif_block(content)
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    try:
        if order is None or struct.unpack_from(order + "H", block, 2)[0] != 42:
            return 1
        (at,) = struct.unpack_from(order + "I", block, 4)
        for k in range(struct.unpack_from(order + "H", block, at)[0]):
            tag, kind, count, value = struct.unpack_from(order + "HHIH", block, at + 2 + 12 * k)
            if (tag, kind, count) == (ORIENTATION_TAG, 3, 1):
                return value if value in UPRIGHT else 1
    except struct.error:  # cut short
        pass
    return 1
