"""What a dialect of chat requests needs: its spans, masked texts put back, and its responses restored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .extract import EXTRACTORS, log_text
from .mask import mask_bodies, restored_blocks, restored_choices


@dataclass(frozen=True)
class Dialect:
    """extract(requests) gives spans; apply(requests, masked) bodies; restore(parts, pii, secrets, marker) the parts of a response;
    log(requests) their texts for the log."""

    name: str
    extract: Callable[[DataFrame], DataFrame]
    apply: Callable[[DataFrame, DataFrame], DataFrame]
    restore: Callable[..., Column]
    log: Callable[[DataFrame], DataFrame]


DIALECTS: dict[str, Dialect] = {}


def register(dialect: Dialect) -> None:
    DIALECTS[dialect.name] = dialect


for _name, _restore in (("A", restored_choices), ("B", restored_blocks)):
    register(Dialect(_name, EXTRACTORS[_name], lambda r, m, n=_name: mask_bodies(r, m, n), _restore, lambda r, n=_name: log_text(r, n)))
