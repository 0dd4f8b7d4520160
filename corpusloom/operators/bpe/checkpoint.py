"""Resumable learning: the merges so far with what they were learned from, replaced as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from ...sources.sinks import atomic_json, read_json
from .learner import learn
from .model import Merge, Symbols


@dataclass
class Checkpoint:
    """One stage's progress in a JSON document. A snapshot of a smaller vocabulary needs no document of its own: it is the merges below its size."""

    path: str
    every: int = 500

    def load(self) -> dict | None:
        return read_json(self.path, None)

    def run(self, units, target: int, symbols: Symbols, fingerprint: str, **how) -> list[Merge]:
        """Learns from where the document ends; refuses one that was made from other data, from other symbols or with other options.

        units as for learn(). A stage that is complete for the target is taken from its document as it is, without looking at the units.
        Under the PMI criterion candidates are listed again on resuming, as they are every pmi_rebuild_every merges.
        """
        key = {"fingerprint": fingerprint, "start": len(symbols), "how": {k: v for k, v in sorted(how.items())}}
        had = self.load()
        if had and {k: had[k] for k in key} != key:
            raise ValueError(f"{self.path} was learned from other data or with other options")
        done = [tuple(m) for m in had["merges"]] if had else []
        need = max(0, target - len(symbols))
        if had and (len(done) >= need or (had.get("complete") and had["target_vocab_size"] >= target)):
            for a, b, _ in done[:need]:
                symbols.merged(a, b)
            return done[:need]

        def keep(merges: list[Merge]) -> None:
            if self.every and len(merges) % self.every == 0:
                atomic_json(self.path, key | {"merges": merges, "target_vocab_size": target})

        merges, _ = learn(units, target, symbols, done=done, on_merge=keep, **how)
        atomic_json(self.path, key | {"merges": merges, "target_vocab_size": target, "complete": True})
        return merges
