"""Numpy kernels over one decoded image (height x width x RGB, uint8)."""

from __future__ import annotations

import functools

import numpy as np

#: A pixel is white from this value on in all channels; a bright region has at least so many of them.
WHITE, REGION = 245, 20


def gray(rgb: np.ndarray) -> np.ndarray:
    """BT.601 luma, rounded; of one image or of a stack."""
    x = rgb.astype(np.int32)
    return np.rint((299 * x[..., 0] + 587 * x[..., 1] + 114 * x[..., 2]) / 1000).astype(np.uint8)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def laplacian_variances(g: np.ndarray) -> np.ndarray:
    """Of the four-neighbour Laplacian of each gray image of a stack, mirrored at the border without repeating it."""
    down, across = (np.array([min(1, n - 1), *range(n), max(n - 2, 0)]) for n in g.shape[1:])
    x = g.astype(np.int32)[:, down][:, :, across]
    return _flat(x[:, :-2, 1:-1] + x[:, 2:, 1:-1] + x[:, 1:-1, :-2] + x[:, 1:-1, 2:] - 4 * x[:, 1:-1, 1:-1]).astype(np.float64).var(1)


def laplacian_variance(g: np.ndarray) -> float:
    return float(laplacian_variances(g[None])[0])


def saturation_means(rgb: np.ndarray) -> np.ndarray:
    top, least = (f(f(rgb[..., 0], rgb[..., 1]), rgb[..., 2]).astype(np.float64) for f in (np.maximum, np.minimum))
    return _flat(np.rint(255 * (top - least) / np.maximum(top, 1))).mean(1)  # 0 where top is


def saturation_mean(rgb: np.ndarray) -> float:
    return float(saturation_means(rgb[None])[0])


def entropies(g: np.ndarray) -> np.ndarray:
    g = _flat(g)
    p = np.bincount((g + 256 * np.arange(len(g))[:, None]).ravel(), minlength=256 * len(g)).reshape(-1, 256) / g.shape[1]
    return np.abs((p * np.log2(np.where(p > 0, p, 1))).sum(1))


def entropy(g: np.ndarray) -> float:
    return float(entropies(g[None])[0])


def _regions(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the 8-connected regions of a stack of masks, and their images: runs of neighbouring rows hang on the first one they reach until none changes."""
    n, height, width = masks.shape
    padded = np.zeros((n, height + 1, width + 2), np.int8)  # a blank row after each image, a blank pixel beside each row
    padded[:, :height, 1:-1] = masks
    step = np.diff(padded.ravel())
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lo, hi = np.searchsorted(end, start - (width + 2), "left"), np.searchsorted(start, end - (width + 2), "right")
    many = np.maximum(hi - lo, 0)
    here = np.repeat(np.arange(len(start)), many)
    above = np.arange(len(here)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    first = np.arange(len(start))
    while len(here):
        a, b = first[here], first[above]
        apart = a != b
        here, above = here[apart], above[apart]
        np.minimum.at(first, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (first != (further := first[first])).any():
            first = further
    size = np.bincount(first, end - start, len(start)).astype(np.int64)
    roots = np.flatnonzero(first == np.arange(len(start)))
    return size[roots], start[roots] // ((height + 1) * (width + 2))


def region_sizes(mask: np.ndarray) -> list[int]:
    """Sizes of 8-connected regions, by joining runs of neighbouring rows."""
    return _regions(mask[None])[0].tolist()


def qualities(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """Quality measures of each of a stack of images of one size."""
    g = gray(rgb)
    white = (rgb >= WHITE).all(3)
    size, image = _regions(white)
    return {
        "brightness": _flat(g).mean(1), "contrast": _flat(g).std(1), "blur_score": laplacian_variances(g), "saturation": saturation_means(rgb),
        "white_pixel_ratio": _flat(white).mean(1), "bright_region_count": np.bincount(image[size >= REGION], minlength=len(rgb)).astype(np.float64), "entropy": entropies(g),
    }


def quality(rgb: np.ndarray) -> dict[str, float]:
    return {name: float(x[0]) for name, x in qualities(rgb[None]).items()}


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * a - 4 * a, 0))


@functools.lru_cache(64)  # images of a set share few sizes
def _weights(source: int, target: int) -> np.ndarray:
    """Bicubic weights of the source's cells for each of the target's; the kernel widens when an image shrinks."""
    scale = source / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    at = np.arange(source) + 0.5
    lo, hi = np.floor(centre - 2 * wide + 0.5), np.floor(centre + 2 * wide + 0.5)
    w = _cubic((at[None] - centre[:, None]) / wide)
    w = np.where((np.arange(source)[None] >= lo[:, None]) & (np.arange(source)[None] < hi[:, None]), w, 0)
    return w / w.sum(1, keepdims=True)


def resize(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic, across and then down, rounded to 8 bits after each."""
    if x.ndim == 3:
        return np.stack([resize(x[..., c], width, height) for c in range(x.shape[2])], 2)
    x = np.clip(np.rint(x.astype(np.float64) @ _weights(x.shape[1], width).T), 0, 255)
    return np.clip(np.rint(_weights(x.shape[0], height) @ x), 0, 255).astype(np.uint8)


def _bits(bits: np.ndarray) -> int:
    value = int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def average_hash(rgb: np.ndarray) -> int:
    """64 bits as a signed integer: cells of an 8 x 8 gray thumbnail that reach its mean, the first the highest bit."""
    small = resize(gray(rgb), 8, 8).astype(np.float64)
    return _bits(small >= small.mean())


def difference_hash(rgb: np.ndarray) -> int:
    """64 bits: in a 9 x 8 thumbnail, cells whose right neighbour is at least as bright."""
    small = resize(gray(rgb), 9, 8).astype(int)
    return _bits(small[:, 1:] >= small[:, :-1])


def grid_embedding(rgb: np.ndarray, side: int = 224) -> np.ndarray:
    """512 numbers: mean and spread of the colours and of the gradients in each cell of an 8 x 8 grid. Deterministic, no model needed."""
    x = resize(rgb, side, side).astype(np.float64) / 255
    g = x @ np.array([0.299, 0.587, 0.114])
    down, across = np.gradient(g)
    planes = np.concatenate((x, g[..., None], np.abs(down)[..., None], np.abs(across)[..., None]), 2)
    step = side // 8
    cells = planes[: step * 8, : step * 8].reshape(8, step, 8, step, 6)
    mean, spread = cells.mean((1, 3)), cells[..., 3:5].std((1, 3))
    return np.concatenate((mean, spread), 2).reshape(-1).astype(np.float32)
