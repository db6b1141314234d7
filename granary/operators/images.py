"""Variants of a page's image for another round of reading. Images are portable any-maps (binary grey or colour), so no image library is needed."""

from __future__ import annotations

import re

import numpy as np

HEADER = re.compile(rb"P([56])\s(?:#[^\n]*\n)?\s*(\d+)\s+(\d+)\s+(\d+)\s")
# Weights of red, green and blue in grey; the sharpening kernel; the level above which a pixel is white.
GREY = (0.299, 0.587, 0.114)
KERNEL = ((-2, -2, -2), (-2, 32, -2), (-2, -2, -2))
WHITE_ABOVE = 170
VARIANTS = ("grayscale", "enhanced", "threshold")


def decoded(image: bytes) -> np.ndarray:
    """Pixels of an any-map, rows x columns or rows x columns x 3; ValueError for anything else."""
    m = HEADER.match(image)
    if not m or int(m.group(4)) != 255:
        raise ValueError("no binary any-map of 8 bits")
    width, height, planes = int(m.group(2)), int(m.group(3)), 3 if m.group(1) == b"6" else 1
    flat = np.frombuffer(image, np.uint8, offset=m.end(), count=width * height * planes)
    return flat.reshape((height, width, 3) if planes == 3 else (height, width))


def encoded(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return f"P{6 if pixels.ndim == 3 else 5}\n{width} {height}\n255\n".encode() + pixels.astype(np.uint8).tobytes()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else np.rint(pixels @ np.array(GREY)).astype(np.uint8)


def stretched(pixels: np.ndarray) -> np.ndarray:
    """The darkest pixel becomes black and the lightest white; an even image stays as it is."""
    low, high = int(pixels.min(initial=255)), int(pixels.max(initial=0))
    return pixels if high <= low else np.rint((pixels.astype(float) - low) * 255 / (high - low)).astype(np.uint8)


def sharpened(pixels: np.ndarray) -> np.ndarray:
    """Convolved with the kernel; pixels at the border stay."""
    out = pixels.astype(float)
    if min(pixels.shape) < 3:
        return pixels
    inner = sum(w * pixels[i : i + pixels.shape[0] - 2, j : j + pixels.shape[1] - 2].astype(float) for i, row in enumerate(KERNEL) for j, w in enumerate(row))
    out[1:-1, 1:-1] = inner / np.sum(KERNEL)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preprocessed(image: bytes, kind: str) -> bytes:
    """The image itself (`original`), or one of VARIANTS: grey; grey, stretched and sharpened; the same in black and white."""
    if kind == "original":
        return image
    pixels = grey(decoded(image))
    if kind != "grayscale":
        pixels = sharpened(stretched(pixels))
    if kind == "threshold":
        pixels = np.where(pixels > WHITE_ABOVE, 255, 0)
    return encoded(pixels)
