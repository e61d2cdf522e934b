"""Which source opens a resource: the first match by merit of a regular expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Registry:
    entries: list[tuple[str, int, Callable]] = field(default_factory=list)

    def add(self, pattern: str, merit: int, factory: Callable) -> None:
        self.entries.append((pattern, merit, factory))

    def find(self, resource: str) -> Callable:
        """The factory of highest merit whose pattern matches; of equal merit the one added first."""
        found = [e for e in self.entries if re.search(e[0], resource)]
        if not found:
            raise LookupError(f"nothing opens {resource}")
        return max(found, key=lambda e: e[1])[2]

    def open(self, spark, resource: str, **options):
        return self.find(resource)(spark, resource, **options)

    def available(self) -> list[str]:
        return [e[0] for e in self.entries]


def default_registry() -> Registry:
    from cadenza.model import Clip
    from cadenza.sources import files, synthetic

    out = Registry()
    out.add(r"^(colour|color):", 50, lambda s, r, rows=250, **o: synthetic.colour(s, rows, **o))
    out.add(r"^silence:", 50, lambda s, r, rows=250, **o: synthetic.silence(s, rows, **o))
    out.add(r"^tone:", 50, lambda s, r, **o: synthetic.tone(s, **o))
    out.add(r"^test:", 50, lambda s, r, **o: synthetic.test_picture(s, **o))
    out.add(r"^nothing:", 50, lambda s, r, **o: synthetic.nothing(s, **o))
    out.add(r"\.parquet$", 60, lambda s, r, key="position", **o: Clip.of(s.read.parquet(r), key, **o))
    out.add(r"^wav:|\.wav$", 90, lambda s, r, **o: files.read_wav(s, r.removeprefix("wav:"), **o))
    out.add(r"^raw:|\.raw$", 50, lambda s, r, **o: files.read_raw(s, r.removeprefix("raw:"), **o))
    out.add(r"^aud:|\.aud$", 50, lambda s, r, **o: files.read_aud(s, r.removeprefix("aud:"), **o))
    out.add(r"\.awi$", 50, lambda s, r, **o: files.read_index(s, r, **o))
    return out
