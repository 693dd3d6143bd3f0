"""Decoders of image bytes, for formats that the JVM can't read (`.webp`): bytes to RGB pixels (height x width x 3, uint8), OSError or ValueError if that fails."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np

Decoder = Callable[[bytes], np.ndarray]


def pillow() -> Decoder:
    """By Pillow, where it is installed on driver and executors."""
    import PIL.Image  # noqa: F401  # fails here, not in a task

    return _by_pillow


def _by_pillow(data: bytes) -> np.ndarray:
    from PIL import Image

    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB"))
