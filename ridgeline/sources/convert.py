"""Offline conversion of an HDF5 dataset to vector and CSV files, on one machine; needs h5py, which is optional."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np


def write_vectors(x: np.ndarray, path: Path) -> None:
    with path.open("wb") as f:
        for row in np.asarray(x, "<f4"):
            f.write(struct.pack("<i", len(row)) + row.tobytes())


def write_attributes(columns: dict[str, np.ndarray], path: Path) -> dict[str, str]:
    """A CSV without quoting: commas become semicolons. Gives each column's kind: numbers numeric, all else categorical."""
    kinds = {k: "numeric" if np.issubdtype(v.dtype, np.number) else "categorical" for k, v in columns.items()}
    text = lambda v: (v.decode() if isinstance(v, bytes) else str(v)).replace(",", ";").replace("\n", " ")
    with path.open("w") as f:
        f.write(",".join(columns) + "\n")
        for row in zip(*columns.values(), strict=True):
            f.write(",".join(map(text, row)) + "\n")
    return kinds


def hdf5_to_files(source: str, out: str, vectors: str, attributes: list[str], queries: int = 200, seed: int = 42) -> dict[str, str]:
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("h5py is needed to read HDF5") from e
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    with h5py.File(source) as f:
        x = np.asarray(f[vectors])
        kinds = write_attributes({c: np.asarray(f[c]) for c in attributes}, folder / "attributes.csv")
    write_vectors(x, folder / "base.fvecs")
    chosen = np.sort(np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False))
    write_vectors(x[chosen], folder / "query.fvecs")
    return kinds
