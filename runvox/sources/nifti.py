"""Decoding one volume file inside a task: header fields and runs of foreground."""

from __future__ import annotations

import gzip
import io
import struct

import numpy as np

# Data type codes of the file format that volumes here use.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def read_header(raw: bytes) -> dict:
    """shape, zooms, affine, dtype, offset and scaling from the first 348 bytes (gzip or plain)."""
    if raw[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as stream:
            raw = stream.read(348)
    if len(raw) < 348:
        raise ValueError("truncated header")
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    get = lambda fmt, at: struct.unpack_from(order + fmt, raw, at)
    if get("i", 0)[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim, pixdim = get("8h", 40), get("8f", 76)
    code, = get("h", 70)
    if code not in DTYPES:
        raise ValueError(f"unsupported data type {code}")
    offset, slope, inter = get("3f", 108)
    qform, sform = get("2h", 252)
    if sform > 0:
        affine = np.vstack([np.array(get("12f", 280)).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        b, c, d, x, y, z = get("6f", 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                         [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                         [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
        handed = pixdim[0] if pixdim[0] in (-1.0, 1.0) else 1.0
        affine = np.eye(4)
        affine[:3, :3] = turn * np.array([pixdim[1], pixdim[2], pixdim[3] * handed])
        affine[:3, 3] = x, y, z
    else:
        affine = np.diag([-pixdim[1], pixdim[2], pixdim[3], 1.0])
        affine[:3, 3] = -affine[:3, :3] @ ((np.array(dim[1:4]) - 1) / 2)
    return {"shape": [int(n) for n in dim[1:1 + dim[0]]], "zooms": [float(p) for p in pixdim[1:4]],
            "affine": affine, "dtype": order + DTYPES[code], "offset": int(offset),
            "slope": slope if slope and np.isfinite(slope) else 1.0, "inter": inter if np.isfinite(inter) else 0.0}


def read_volume(raw: bytes) -> tuple[dict, np.ndarray]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head = read_header(raw)
    shape = [n for n in head["shape"][:3]] + [1] * (3 - len(head["shape"][:3]))
    if any(n != 1 for n in head["shape"][3:]):
        raise ValueError(f"expected a 3-D volume, found {head['shape']}")
    data = np.frombuffer(raw, head["dtype"], int(np.prod(shape)), head["offset"]).reshape(shape, order="F")
    if head["slope"] != 1.0 or head["inter"] != 0.0:
        data = data * head["slope"] + head["inter"]
    return head | {"shape": shape}, data


def runs_of(labels: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of equal non-zero label along z."""
    values = labels.astype(np.int32)
    edge = np.ones(values.shape[:2] + (values.shape[2] + 1,), bool)
    edge[:, :, 1:-1] = values[:, :, 1:] != values[:, :, :-1]
    x, y, z = np.nonzero(edge[:, :, :-1])
    stop = np.nonzero(edge[:, :, 1:])[2]
    label = values[x, y, z]
    keep = label != 0
    return {"label": label[keep], "x": x[keep].astype(np.int32), "y": y[keep].astype(np.int32),
            "z0": z[keep].astype(np.int32), "z1": stop[keep].astype(np.int32)}
