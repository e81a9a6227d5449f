"""Languages by name: the five that come with the package, and those that callers add while they run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import Column

from copse.providers import catalog
from copse.providers.tree import Node


def _nothing(*_) -> str:
    return ""


@dataclass(frozen=True)
class Provider:
    """What a language needs. parse: a text to the root of its tree. bindings: a node and the text to what it declares.
    kinds: kind to node types; canonical: other spellings of kinds; the other functions and ``checks`` (kind to a condition
    on elements) are optional. Functions run on executors: they must be importable there or be pickled with what they use."""

    language: str
    parse: Callable[[str], Node]
    bindings: Callable
    kinds: dict[str, tuple[str, ...]]
    extensions: tuple[str, ...] = ()
    canonical: dict[str, str] = field(default_factory=dict)
    declared_type: Callable = _nothing
    exported: Callable = lambda name: False
    member: Callable = _nothing
    checks: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def names(self) -> SimpleNamespace:
        return SimpleNamespace(bindings=self.bindings, declared_type=self.declared_type, exported=self.exported, member=self.member)


_ADDED: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    """Add a language, or put a new provider in the place of an added one or of one that comes with the package."""
    if not provider.language:
        raise ValueError("a provider needs a language")
    _ADDED[provider.language] = provider


def unregister(language: str) -> None:
    _ADDED.pop(language, None)


def added(language: str) -> Provider | None:
    return _ADDED.get(language)


def languages() -> tuple[str, ...]:
    return (*catalog.LANGUAGES, *(x for x in _ADDED if x not in catalog.LANGUAGES))


def extensions() -> dict[str, str]:
    """Of added languages, by lower-case extension."""
    return {e.lower(): p.language for p in _ADDED.values() for e in p.extensions}


def parser(language: str):
    """(parse, functions of names) of a language, or None."""
    from copse.providers import ecma, golang, php, python

    if language in _ADDED:
        return _ADDED[language].parse, _ADDED[language].names()
    return {
        "go": (golang.parse, golang), "python": (python.parse, python), "php": (php.parse, php),
        "javascript": (ecma.parse_javascript, ecma), "typescript": (ecma.parse_typescript, ecma),
    }.get(language)
