"""Vectors of images by a model that takes them in batches, and a residual network in numpy that reads its weights from a file."""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from .kernels import resize

#: Fixed by the usual training of such networks: mean and deviation of red, green and blue, of 0 to 1.
CHANNEL_MEAN, CHANNEL_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Bytes of unfolded windows that a convolution holds at a time, and what batch normalisation adds to a variance.
HELD, EPSILON = 32 << 20, 1e-5


@dataclass(frozen=True)
class Batched:
    """An embedder over stacked images: model takes n x side x side x 3 normalised floats, n up to size, and gives n vectors.

    Images are resized without regard to their shape. Batches are full but for the last of a task. Unreadable files get no vector, or (blank) that of a black image.
    A vector may differ in its last bits with the size of its batch, as products of matrices do.
    """

    model: Callable[[np.ndarray], np.ndarray]
    side: int = 224
    size: int = 32
    mean: tuple[float, float, float] = CHANNEL_MEAN
    deviation: tuple[float, float, float] = CHANNEL_DEVIATION
    blank: bool = False

    def fitted(self, rgb: np.ndarray | None) -> np.ndarray:
        """One image as the model's input before it is normalised: 8 bits, so that waiting images stay small."""
        return np.zeros((self.side, self.side, 3), np.uint8) if rgb is None else resize(rgb, self.side, self.side)

    def vectors(self, fitted: Sequence[np.ndarray]) -> np.ndarray:
        x = (np.stack(fitted).astype(np.float32) / 255 - np.float32(self.mean)) / np.float32(self.deviation)
        out = np.asarray(self.model(x), np.float32)
        if out.ndim != 2 or len(out) != len(x):
            raise ValueError(f"the model gave {out.shape} for {len(x)} images")
        return out


def convolve(x: np.ndarray, weight: np.ndarray, stride: int = 1, pad: int = 0) -> np.ndarray:
    """x: n x height x width x channels; weight: outputs x channels x height x width. Windows are unfolded for some images at a time."""
    outputs, channels, high, wide = weight.shape
    x = np.pad(x, ((0, 0), (pad, pad), (pad, pad), (0, 0)))
    seen = sliding_window_view(x, (high, wide), (1, 2))[:, ::stride, ::stride]
    flat = weight.reshape(outputs, -1).T
    each = max(1, HELD // (int(np.prod(seen.shape[1:])) * x.itemsize))
    parts = [seen[i : i + each].reshape(-1, channels * high * wide) @ flat for i in range(0, len(x), each)]
    return np.concatenate(parts).reshape(len(x), *seen.shape[1:3], outputs)


def largest(x: np.ndarray, side: int = 3, stride: int = 2, pad: int = 1) -> np.ndarray:
    """Maxima of windows; what lies outside counts as minus infinity."""
    x = np.pad(x, ((0, 0), (pad, pad), (pad, pad), (0, 0)), constant_values=-np.inf)
    return sliding_window_view(x, (side, side), (1, 2))[:, ::stride, ::stride].max((4, 5))


class Residual:
    """Blocks of convolutions with a short cut, as many as the weights have; what they give is averaged over the image.

    Weights carry the names of the public layout of such networks: `conv1`, `bn1`, `layer<stage>.<block>.conv<i>`, `.bn<i>`, `.downsample.0`, `.downsample.1`.
    A block of two convolutions strides in its first, one of three in its second; all stages but the first halve the image.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self._layers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._blocks: list[tuple[str, int, int]] = []
        self._fold(weights, "conv1", "bn1")
        stage = 1
        while f"layer{stage}.0.conv1.weight" in weights:
            block = 0
            while f"layer{stage}.{block}.conv1.weight" in weights:
                at = f"layer{stage}.{block}"
                steps = 3 if f"{at}.conv3.weight" in weights else 2
                for i in range(1, steps + 1):
                    self._fold(weights, f"{at}.conv{i}", f"{at}.bn{i}")
                if f"{at}.downsample.0.weight" in weights:
                    self._fold(weights, f"{at}.downsample.0", f"{at}.downsample.1")
                self._blocks.append((at, steps, 2 if stage > 1 and block == 0 else 1))
                block += 1
            stage += 1

    def _fold(self, weights: dict[str, np.ndarray], conv: str, norm: str) -> None:
        """Normalisation with fixed statistics is a factor and an addend of the convolution before it."""
        missing = [n for n in (f"{conv}.weight", f"{norm}.weight", f"{norm}.bias", f"{norm}.running_mean", f"{norm}.running_var") if n not in weights]
        if missing:
            raise ValueError(f"the weights lack {', '.join(missing)}")
        factor = weights[f"{norm}.weight"].astype(np.float64) / np.sqrt(weights[f"{norm}.running_var"].astype(np.float64) + EPSILON)
        addend = weights[f"{norm}.bias"] - weights[f"{norm}.running_mean"] * factor
        self._layers[conv] = (weights[f"{conv}.weight"] * factor[:, None, None, None]).astype(np.float32), addend.astype(np.float32)

    def _layer(self, x: np.ndarray, name: str, stride: int = 1) -> np.ndarray:
        weight, addend = self._layers[name]
        return convolve(x, weight, stride, weight.shape[2] // 2) + addend

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = largest(np.maximum(self._layer(x, "conv1", 2), 0))
        for at, steps, stride in self._blocks:
            y = x
            for i in range(1, steps + 1):
                y = self._layer(y, f"{at}.conv{i}", stride if i == steps - 1 else 1)
                if i < steps:
                    y = np.maximum(y, 0)
            short = self._layer(x, f"{at}.downsample.0", stride) if f"{at}.downsample.0" in self._layers else x
            x = np.maximum(y + short, 0)
        return x.mean((1, 2))


@lru_cache(maxsize=2)
def _loaded(path: str) -> Residual:
    from ..sources.files import opened

    with np.load(io.BytesIO(opened(path)), allow_pickle=False) as stored:
        return Residual(dict(stored))


@dataclass(frozen=True)
class FromFile:
    """A Residual of the weights in an .npz file, by a path or URI that all workers reach; each loads it once. Only the path is sent to tasks."""

    path: str

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return _loaded(self.path)(batch)


def network(path: str, side: int = 224, size: int = 32) -> Batched:
    """A batched embedder of a weight file. The file is read here too, so that a wrong one fails before any image is opened."""
    _loaded(path)
    return Batched(FromFile(path), side, size)
