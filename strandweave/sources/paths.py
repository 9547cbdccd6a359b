"""Paths that commands may read and write."""

from __future__ import annotations

from pathlib import Path


def safe_graph_path(path: str, base: str = ".", output_dir: str = "graph-out") -> Path:
    """The real path of an existing file below ``base``/``output_dir``; a relative one is looked for there.

    FileNotFoundError if there is none, PermissionError if it lies elsewhere, by '..' or by a link.
    """
    root = Path(base).resolve() / output_dir
    try:
        found = (root / path).resolve(strict=True)
    except (OSError, RuntimeError) as e:
        raise FileNotFoundError(path) from e
    if found != root and root not in found.parents:
        raise PermissionError(f"{path} is outside of {output_dir}")
    return found
