"""What a store is: a DataFrame with an id, optional field modes and query limits."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from vellum.errors import QueryError

#: How a declared field is searched. ``text`` turns lists and ``contains`` into token search; ``numeric`` reads numbers
#: out of strings; ``exact`` changes nothing. ``True`` stands for ``text``, ``False`` for an undeclared field.
MODES = ("exact", "text", "numeric")


@dataclass(frozen=True)
class Identity:
    """How new ids are drawn."""

    chars: str = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    length: int = 16
    auto_expand: bool = False

    @property
    def health(self) -> str:
        """``degraded`` for very long ids, ``low`` where growth will soon make them so, else ``ok``."""
        if self.length > 32:
            return "degraded"
        return "low" if self.auto_expand and self.length >= 28 else "ok"


@dataclass(frozen=True)
class StoreSpec:
    """Declares a store over a DataFrame.

    key: the columns whose values, as text, make up ``_id`` (joined by ``|``); without any, the whole row is hashed.
    fields: search mode of fields, see ``MODES``. doc: column with the JSON or VARIANT body of a schemaless store; its
    fields are then looked up in the body. nested: whether a dotted name is a path. default_limit: page size where a
    query has none (0 or less: no limit). indexes: tables of token postings (``operators.index.write_index``) of fields in
    ``text`` mode, which token search then reads in place of the texts; they hold what records said when written. depth_limit: how deep filters may nest. timeout_ms, slow_query_ms: 0 is off.
    """

    name: str
    key: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)
    doc: str | None = None
    nested: bool = False
    default_limit: int = 300
    depth_limit: int = 12
    indexes: dict[str, str] = field(default_factory=dict)
    timeout_ms: float = 0.0
    slow_query_ms: float = 0.0
    identity: Identity = Identity()

    def __post_init__(self) -> None:
        declared = {name: "text" if mode is True else mode for name, mode in self.fields.items() if mode is not False and mode is not None}
        if unknown := {mode for mode in declared.values() if mode not in MODES}:
            raise QueryError(f"unknown search modes: {sorted(map(str, unknown))}")
        object.__setattr__(self, "fields", declared)
        object.__setattr__(self, "key", (self.key,) if isinstance(self.key, str) else tuple(self.key))

    def changed(self, **changes) -> StoreSpec:
        return replace(self, **changes)

    def export(self) -> dict:
        """The declaration as JSON-ready data."""
        return asdict(self)

    @classmethod
    def load(cls, data: dict) -> StoreSpec:
        return cls(**{**data, "identity": Identity(**data.get("identity", {}))})
