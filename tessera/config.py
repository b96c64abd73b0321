"""What a scan can be told."""

from __future__ import annotations

from dataclasses import dataclass, field

LANGUAGES = ("python", "typescript", "rust")
#: Section names that ``skip`` accepts, by language (fixed values).
_SHARED = "inventory complexity cognitive nesting imports coupling cycles dead-exports todo-audit code-clones security-audit test-prod"
SECTIONS = {
    "python": frozenset(f"{_SHARED} mutable-defaults silent-except decorators routes".split()),
    "typescript": frozenset(f"{_SHARED} component-props hooks silent-catches eslint-disables ts-directives any-audit console-debugger mobx-observer orm-case-check import-boundaries".split()),
    "rust": frozenset(f"{_SHARED} unsafe-audit unwrap-audit allow-lints derive-audit traits parse-errors".split()),
}


@dataclass(frozen=True)
class BoundaryRule:
    """Files whose shown path starts with ``source`` may not import anything that starts with one of ``forbidden``."""

    source: str
    forbidden: tuple[str, ...]

    @staticmethod
    def parse(flag: str) -> BoundaryRule:
        """``source:forbidden,forbidden``, split at the first colon."""
        source, colon, rest = flag.partition(":")
        forbidden = tuple(p.strip() for p in rest.split(",") if p.strip())
        if not colon or not source.strip() or not forbidden:
            raise ValueError(f"bad boundary {flag!r}: expected source:forbidden[,forbidden]")
        return BoundaryRule(source.strip(), forbidden)


@dataclass(frozen=True)
class Gates:
    """Thresholds; a value above one breaches it.  None is no gate."""

    max_complexity: int | None = None
    max_cognitive: int | None = None
    max_params: int | None = None
    max_nesting: int | None = None
    max_lines: int | None = None
    max_cycles: int | None = None


@dataclass(frozen=True)
class ScanConfig:
    root: str
    languages: tuple[str, ...] = ()
    package: str | None = None
    alias: str = "@/"
    exclude: tuple[str, ...] = ()
    orm_methods: tuple[str, ...] = ()
    boundaries: tuple[BoundaryRule, ...] = ()
    top: int = 20
    skip: frozenset[str] = frozenset()
    gates: Gates = field(default_factory=Gates)

    def __post_init__(self) -> None:
        alias = self.alias.strip()
        object.__setattr__(self, "alias", alias if not alias or alias.endswith("/") else alias + "/")
        if self.package is None:
            object.__setattr__(self, "package", self.root.rstrip("/").rsplit("/", 1)[-1])

    def check_skip(self, languages: tuple[str, ...]) -> None:
        """Every skipped section must exist in one of the languages."""
        known = frozenset().union(*(SECTIONS[lang] for lang in languages))
        if unknown := sorted(set(self.skip) - known):
            raise ValueError(f"unknown section(s): {', '.join(unknown)}; known: {', '.join(sorted(known))}")
