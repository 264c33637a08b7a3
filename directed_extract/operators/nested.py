"""Deeply nested JSON records as related flat tables with parent-child links."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from directed_extract.functions import jsonx
from directed_extract.session import cut

#: In an object with more different field names than this, over all records, those not declared are a map (its keys are
#: data, not structure).
MAX_FIELDS = 64
#: Mark of places where text stood for the list or object it holds; only there is text looked into again.
WRAPPED = "wrapped"
#: The parser's own limit: what is nested deeper is no JSON to it. The walk must be able to follow.
PARSER_DEPTH = 1000


@dataclass
class Node:
    """One place of the merged structure: the kinds of value seen there and what is below it."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Node] = field(default_factory=dict)
    item: Node | None = None
    value: Node | None = None

    @property
    def real(self) -> set[str]:
        """The kinds other than null."""
        return self.kinds - {"null", WRAPPED}

    @property
    def is_list(self) -> bool:
        return self.item is not None

    @property
    def is_map(self) -> bool:
        return self.value is not None and not self.fields

    @property
    def is_open(self) -> bool:
        """An object with known fields and a map of all others."""
        return self.value is not None and bool(self.fields)


def _unwrapped(v: object) -> object:
    if isinstance(v, str) and (t := v.strip()) and ((t[0], t[-1]) in (("{", "}"), ("[", "]"))):
        try:
            return json.loads(t)
        except ValueError:
            return v
    return v


#: The kinds of the types that the parser makes.
_KINDS = {type(None): "null", bool: "boolean", int: "bigint", float: "double", str: "string", list: "array", dict: "object"}


class _Seen:
    """One place of the records read so far: kinds, what is below it by name, and what is in its lists."""

    __slots__ = ("kinds", "names", "item", "value")

    def __init__(self) -> None:
        self.kinds: set[str] = set()
        self.names: dict[str, _Seen] = {}
        self.item: _Seen | None = None
        self.value: _Seen | None = None

    def paths(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
        todo = [(path, self)]
        while todo:
            at, node = todo.pop()
            yield from ((at, k) for k in node.kinds)
            todo += [((*at, "." + k), x) for k, x in node.names.items()]
            todo += [((*at, step), x) for step, x in (("[]", node.item), ("{}", node.value)) if x is not None]


class _Reader:
    """Reads records into one :class:`_Seen`, counting its places. ``maps`` are the declared maps."""

    def __init__(self, maps: set[tuple[str, ...]]) -> None:
        self.root, self.places, self.maps = _Seen(), 1, {}
        for path in maps:
            at = self.maps
            for step in path:
                at = at.setdefault(step, {})
            at["map"] = {}

    def below(self, node: _Seen, side: str) -> _Seen:
        child = getattr(node, side)
        if child is None:
            child = _Seen()
            setattr(node, side, child)
            self.places += 1
        return child

    def walk(self, v: object, node: _Seen, declared: dict | None, depth: int = 0) -> None:
        if depth > PARSER_DEPTH:
            raise ValueError("nested deeper than the parser reads")
        if type(v) is str and v and v[-1:] in "]} \t\r\n" and (inner := _unwrapped(v)) is not v:
            node.kinds.add(WRAPPED)
            v = inner
        node.kinds.add(_KINDS[type(v)])
        if type(v) is list:
            if v:
                item, under = self.below(node, "item"), declared.get("[]") if declared else None
                for x in v:
                    self.walk(x, item, under, depth + 1)
        elif type(v) is dict:
            if declared and "map" in declared:
                if v:
                    value, under = self.below(node, "value"), declared.get("{}")
                    for x in v.values():
                        self.walk(x, value, under, depth + 1)
                return
            names = node.names
            for k, x in v.items():
                child = names.get(k)
                if child is None:
                    child = names[k] = _Seen()
                    self.places += 1
                self.walk(x, child, declared.get("." + k) if declared else None, depth + 1)

    def read(self, text: str) -> None:
        """One record; what is no JSON object leaves nothing behind."""
        try:
            record = json.loads(text)
            if not isinstance(record, dict):
                return
            if text.count("[") + text.count("{") > PARSER_DEPTH:  # may turn out too deep half-way
                self.walk(record, _Seen(), self.maps)
            self.walk(record, self.root, self.maps)
        except (TypeError, ValueError, RecursionError):
            return


def steps(path: str) -> tuple[str, ...]:
    """``a.b[].c{}`` as the steps ``.a .b [] .c {}``."""
    out: list[str] = []
    for part in path.split("."):
        name = part.replace("[]", "").replace("{}", "")
        out += ["." + name] if name else []
        rest = part[len(name) :]
        out += [rest[i : i + 2] for i in range(0, len(rest), 2)]
    return tuple(out)


def infer_structure(df: DataFrame, raw: str, maps: Iterable[str] = (), lists: Iterable[str] = (), max_fields: int = MAX_FIELDS, fields: Iterable[str] = ()) -> Node:
    """The merged structure of all JSON objects in column ``raw``.

    Every record is read; each partition gives the distinct (place, kind) pairs it saw. What
    reaches the driver is the structure itself, bounded by the number of different places: objects named in ``maps`` count
    as maps and share one place for all their values. So do the fields of objects with more than ``max_fields`` field
    names, but for those that are declared or lead to what is. Rows that are no JSON object say nothing. ``lists`` names
    places that hold lists even where the data only has single values, ``fields`` others that are known.
    """
    maps, lists, fields = list(maps), list(lists), list(fields)
    declared = {steps(m) for m in maps}
    kept = {_place(steps(p)[: i + 1]) for p in (*maps, *lists, *fields) for i in range(len(steps(p)))}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * PARSER_DEPTH))
        reader, seen = _Reader(declared), set()
        for batch in batches:
            for text in batch["raw"]:
                reader.read(text)
            if reader.places > 100_000:  # an undeclared map: its keys must not pile up
                seen = _folded(seen | set(reader.root.paths()), max_fields, kept)
                reader = _Reader(declared)
        seen = _folded(seen | set(reader.root.paths()), max_fields, kept)
        if seen:
            rows = [(json.dumps(p), k) for p, k in seen]
            yield pd.DataFrame(rows, columns=["path", "kind"]).astype({"path": object, "kind": object})

    found = df.select(F.col(raw).cast("string").alias("raw")).mapInPandas(scan, "path string, kind string")
    seen = _folded({(tuple(json.loads(r.path)), r.kind) for r in found.distinct().collect()}, max_fields, kept)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * PARSER_DEPTH))
    root = Node()
    for path, kind in seen:
        _at(root, path).kinds.add(kind)
    for path in lists:
        node = _at(root, steps(path))
        node.item = node.item or Node()
    for path in maps:
        node = _at(root, steps(path))
        node.value = node.value or Node()
    for path in fields:
        _at(root, steps(path))
    _settle(root)
    return root


def _place(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without lists: a list of objects and a single object in its stead are one place."""
    return tuple(step for step in path if step != "[]")


def _folded(seen: set, max_fields: int, kept: set[tuple[str, ...]]) -> set:
    """In objects with too many field names, all fields but those in ``kept`` become the values of a map.

    Folded fields share what is below them, which may then be too much in turn. Where a part of the data was folded before,
    the rest follows.
    """
    while True:
        names: dict[tuple[str, ...], set[str]] = {}
        for path in {p for p, _ in seen}:
            at: tuple[str, ...] = ()
            for step in path:
                if step != "[]":
                    names.setdefault(at, set()).add(step)
                    at = (*at, step)
        loose = {p for p, n in names.items() if (len(n) > max_fields or "{}" in n) and any(s != "{}" and (*p, s) not in kept for s in n)}
        if not loose:
            return seen
        out = set()
        for path, kind in seen:
            new, at = [], ()
            for step in path:
                below = at if step == "[]" else (*at, step)
                new.append("{}" if step != "[]" and at in loose and below not in kept else step)
                at = below
            out.add((tuple(new), kind))
        seen = out


def _at(root: Node, path: tuple[str, ...]) -> Node:
    node = root
    for step in path:
        if step == "[]":
            node.item = node.item or Node()
            node = node.item
        elif step == "{}":
            node.value = node.value or Node()
            node = node.value
        else:
            node = node.fields.setdefault(step[1:], Node())
    return node


def _merge(into: Node, other: Node) -> None:
    into.kinds |= other.kinds
    for k, v in other.fields.items():
        _merge(into.fields.setdefault(k, Node()), v)
    for side in ("item", "value"):
        if (v := getattr(other, side)) is not None:
            if getattr(into, side) is None:
                setattr(into, side, Node())
            _merge(getattr(into, side), v)


def _settle(node: Node) -> None:
    """Where lists and single values meet, the place is a list, and single values are lists of one."""
    if node.item is not None:
        bare = node.real - {"array"}
        if bare or node.fields:
            _merge(node.item, Node(bare, node.fields, None, node.value))
            node.fields, node.value = {}, None
    for child in [*node.fields.values(), *(x for x in (node.item, node.value) if x is not None)]:
        _settle(child)


def _opened(v: Column, node: Node) -> Column:
    """The value with text replaced by the list or object it holds. What has an item or a known field is no text, which is
    cheaper to see than the kind of a large value."""
    if WRAPPED not in node.kinds:
        return v
    inside = node.item if node.item is not None and not node.fields else node
    steps = (["$[0]"] if node.item is not None else []) + [_step(name) for name in sorted(inside.fields)[:2]]
    if not steps:
        return jsonx.unwrap_text(v)
    return jsonx.let(v, lambda x: F.when(F.coalesce(*[F.try_variant_get(x, step, "variant") for step in steps]).isNotNull(), x).otherwise(jsonx.unwrap_text(x)))


def _step(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _get(v: Column, name: str, node: Node) -> Column:
    return _opened(F.try_variant_get(v, _step(name), "variant"), node)


def _scalar(v: Column, kinds: set[str]) -> Column:
    """One type if the place only has one, else text; objects and lists that have no table of their own stay JSON."""
    kind = "bigint" if kinds == {"bigint"} else "double" if kinds and kinds <= {"bigint", "double"} else "boolean" if kinds == {"boolean"} else None
    if kind or kinds == {"string"}:
        return F.try_variant_get(v, "$", kind or "string")
    return jsonx.let(v, lambda x: F.when(~F.is_variant_null(x), F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))


def _plain(node: Node, v: Column, prefix: str = "") -> list[Column]:
    """The scalar columns of an object, those of objects inside it with dotted names."""
    out = []
    for name, child in sorted(node.fields.items()):
        at = _get(v, name, child)
        if child.is_list or child.is_map:
            continue
        if child.fields:
            out += _plain(child, at, f"{prefix}{name}.")
        if not child.fields or child.real - {"object"}:
            out.append(_scalar(at, child.real).alias(f"{prefix}{name}"))
    return out


def _children(node: Node, path: str, v: Column) -> Iterator[tuple[str, Node, Column]]:
    """The lists and maps directly below a row, also those in objects inside it, and the other fields of open objects."""
    if node.is_open:
        yield path, node, v
    for name, child in sorted(node.fields.items()):
        at, here = _get(v, name, child), f"{path}.{name}" if path else name
        if child.is_list or child.is_map:
            yield here, child, at
        else:
            yield from _children(child, here, at)


def _entries(node: Node, v: Column) -> Column:
    """The entries of a list or map as ``array<struct<label, pos, v>>``; a single value is a list of one, null is empty."""
    if node.is_list:
        listed = lambda x: F.try_variant_get(x, "$", "array<variant>")
        several = lambda x: F.coalesce(listed(x), F.when(x.isNotNull() & ~F.is_variant_null(x), F.array(x)))
        items = jsonx.let(v, several) if node.real - {"array"} else listed(v)
        return F.transform(items, lambda x, i: F.struct(i.cast("string").alias("label"), i.alias("pos"), _opened(x, node.item).alias("v")))
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    if node.is_open:
        pairs = F.filter(pairs, lambda e: ~e["key"].isin(sorted(node.fields)))
    return F.transform(pairs, lambda e, i: F.struct(e["key"].alias("label"), i.alias("pos"), _opened(e["value"], node.value).alias("v")))


def _once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    made: list[DataFrame] = []

    def get() -> DataFrame:
        if not made:
            made.append(make())
        return made[0]

    return get


class Tables(Mapping):
    """Tables by name, each built when it is asked for."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable[[], DataFrame]] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def flatten(df: DataFrame, raw: str, key: str, structure: Node) -> Tables:
    """One flat table for the records (``$``) and one for each list or map at any depth (``a[]``, ``a[].b{}`` ...).

    Where only some fields of an object are known, the others are the entries of a map table of that object (``a{}``; ``{}``
    for the record itself).

    Every row names its record (``key``), its own surrogate key (``row_key``, the labels from the record down, joined by
    ``/``), its parent's (``parent_key``; empty for children of the record), the parent's own label (``parent_label``), its
    ``label`` (place in the list as text, or key of the map) and ``pos`` (0-based place). ``kind`` is the kind of JSON
    value, ``value`` the value itself where it is a scalar, ``f`` a struct with the scalar fields of objects, named by
    their dotted path, and ``parent`` the same of the object the list or map is in. Missing and null fields are NULL, a null item keeps its place as a row of kind ``null``, a single
    value where a list belongs is a list of one, text that holds a JSON list or object stands for it.

    Records that are no JSON object give no row. The text is parsed once, into the checkpoint folder. The tables are lazy,
    read only what they need and need no shuffle: each level is exploded from its parent within the row. Columns of ``df`` other than ``raw`` and ``key`` play no part.
    """
    root = cut(df.select(F.col(f"`{key}`").alias("id"), jsonx.parse_object(F.col(f"`{raw}`")).alias("v")).filter("v is not null"))
    out = Tables()

    def shaped(rows: DataFrame, node: Node) -> DataFrame:
        f = _plain(node, F.col("v"))
        scalars = node.real - {"object", "array"}
        value = _scalar(F.col("v"), scalars)
        if node.real & {"object", "array"}:
            schema = F.schema_of_variant(F.col("v"))
            value = F.when(~(schema.startswith("OBJECT") | schema.startswith("ARRAY")), value)
        return rows.select(
            F.col("id").alias(key), "parent_key", "parent_label", "row_key", "label", "pos", jsonx.kind(F.col("v")).alias("kind"),
            value.alias("value"),
            (F.struct(*f) if f else F.lit(None).cast("struct<none:string>")).alias("f"), "parent",
        )

    def below(rows: Callable[[], DataFrame], node: Node, path: str) -> None:
        def inside() -> DataFrame:
            f = _plain(node, F.col("v"))
            return rows().withColumn("parent", F.struct(*f) if f else F.lit(None).cast("struct<none:string>"))

        parents = _once(inside)
        for here, child, at in _children(node, path, F.col("v")):
            grow(parents, child, here, at)

    def grow(rows: Callable[[], DataFrame], child: Node, here: str, at: Column) -> None:
        name = here + ("[]" if child.is_list else "{}")
        inner = child.item if child.is_list else child.value

        def exploded() -> DataFrame:
            e = rows().select("id", F.col("row_key").alias("parent_key"), F.col("label").alias("parent_label"), "parent", F.explode(_entries(child, at)).alias("e"))
            escaped = F.regexp_replace(F.regexp_replace("e.label", "~", "~0"), "/", "~1")
            own = F.when(F.col("parent_key") == "", escaped).otherwise(F.concat_ws("/", "parent_key", escaped))
            return e.select("id", "parent_key", "parent_label", "parent", own.alias("row_key"), "e.label", "e.pos", "e.v")

        each = _once(exploded)
        out.makers[name] = lambda: shaped(each(), inner)
        if inner.is_list or inner.is_map:
            grow(each, inner, name, F.col("v"))
        below(each, inner, name)

    top = root.select("id", F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("parent_label"), F.lit("").alias("row_key"), F.lit("").alias("label"), F.lit(0).alias("pos"), F.lit(None).cast("struct<none:string>").alias("parent"), "v")
    out.makers["$"] = lambda: shaped(top, structure)
    if structure.is_map:
        grow(lambda: top, structure, "", F.col("v"))
    below(lambda: top, structure, "")
    return out
