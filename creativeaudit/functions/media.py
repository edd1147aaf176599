"""Byte-level expressions over media payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creativeaudit import constants as C


def _starts(content: Column, hex_magic: str, at: int = 1) -> Column:
    magic = F.unhex(F.lit(hex_magic))
    return F.substring(content, at, len(hex_magic) // 2) == magic


def media_kind(content: Column) -> Column:
    """P2: 'video' or 'image', from container magic and nothing else."""
    ebml = _starts(content, "1A45DFA3")
    ftyp = _starts(content, "66747970", 5)
    return F.when(ebml | ftyp, "video").otherwise("image")


def image_mime(content: Column) -> Column:
    """MIME type from the image magic; NULL when unrecognised."""
    return (
        F.when(_starts(content, "FFD8FF"), "image/jpeg")
        .when(_starts(content, "89504E470D0A1A0A"), "image/png")
        .when(_starts(content, "474946383761") | _starts(content, "474946383961"), "image/gif")
        .when(_starts(content, "52494646") & _starts(content, "57454250", 9), "image/webp")
    )


def reject_code(kind: Column, n_bytes: Column, duration_s: Column, n_frames: Column,
                mime: Column | None = None, *,
                max_image_bytes: int = C.MAX_IMAGE_BYTES,
                max_video_bytes: int = C.MAX_VIDEO_BYTES,
                max_duration_s: float = C.MAX_DURATION_S) -> Column:
    """First rule broken, cheapest rule first; NULL when the item passes.

    All bounds are strict. A duration of 0 or NULL means unknown and passes.
    """
    image, video = kind == "image", kind == "video"
    code = (
        F.when(n_bytes == 0, "INVALID_IMAGE")
        .when(image & (n_bytes > max_image_bytes), "IMAGE_TOO_LARGE")
        .when(video & (n_bytes > max_video_bytes), "VIDEO_TOO_LARGE")
        .when(video & (duration_s > max_duration_s), "VIDEO_TOO_LONG")
        .when(video & (n_frames == 0), "INVALID_VIDEO")
    )
    if mime is not None:
        code = code.when(image & mime.isNull(), "INVALID_IMAGE")
    return code
