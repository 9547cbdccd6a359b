"""What an extractor finds in a file, and how symbols are named."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def make_id(*parts: str) -> str:
    """'_' and '.' trimmed from each part, joined by '_', other runs '_', lower case."""
    joined = "_".join(q for p in parts if (q := p.strip("_.")))
    return re.sub(r"[^A-Za-z0-9]+", "_", joined).strip("_").lower()


def file_stem(path: str) -> str:
    """parent.stem, or the stem at the root."""
    *folders, name = path.split("/")
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return f"{folders[-1]}.{stem}" if folders and folders[-1] else stem


@dataclass
class Found:
    """Rows of one file: nodes (id, label, line), edges (source, target, relation, line), stubs (source, name, line)."""

    path: str
    nodes: list[tuple[str, str, int]] = field(default_factory=list)
    edges: list[tuple[str, str, str, int]] = field(default_factory=list)
    stubs: list[tuple[str, str, int]] = field(default_factory=list)
    error: str | None = None

    def __post_init__(self):
        self.file_id = make_id(self.path)
        self.stem = file_stem(self.path)
        self.nodes.append((self.file_id, self.path.split("/")[-1], 1))

    def symbol(self, name: str, line: int, owner: str | None = None, container: str | None = None, call: bool = True) -> str:
        """A class-like or callable symbol; methods carry their class in the id once."""
        sid = make_id(self.stem, container or "", name)
        label = f".{name}()" if container and call else f"{name}()" if call else name
        self.nodes.append((sid, label, line))
        self.edges.append((owner or self.file_id, sid, "method" if container and call else "contains", line))
        return sid
