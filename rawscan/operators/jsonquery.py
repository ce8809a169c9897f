"""A conjunctive JSON query over dotted paths: filters, existence tests and projections.

The tree of paths becomes the least schema for ``from_json``; nothing is inferred
from data.  String and existence leaves are read as variants, so that a number, an
object or an array under a string path fails rather than being turned into text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.literals import as_predicate, is_sound_token

LEAF = {"string": T.VariantType(), "int": T.LongType(), "bool": T.BooleanType(), "any": T.VariantType(), "double": T.DoubleType()}


class Node:
    def __init__(self, kind: str | None = None):
        self.kind = kind  # None: an object on the way to others
        self.children: dict[str, Node] = {}
        self.predicates: list = []
        self.exists = False

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(k, n.type()) for k, n in self.children.items()])

    def type(self) -> T.DataType:
        if self.children:
            return self.struct()
        if self.kind.startswith("array<") or self.kind == "array":
            return T.VariantType()
        return LEAF[self.kind]


class JsonQuery:
    def __init__(self):
        self.root = Node()
        self.projections: dict[str, str] = {}

    def _leaf(self, path: str, kind: str) -> Node:
        node, parts = self.root, path.split(".")
        if not all(parts):
            raise ValueError(f"empty component in path {path!r}")
        for k, part in enumerate(parts):
            if node.kind is not None:
                raise ValueError(f"{path!r} goes through a path that is a leaf")
            clash = [c for c in node.children if c.lower() == part.lower() and c != part]
            if clash:
                raise ValueError(f"{part!r} and {clash[0]!r} differ in case only")
            known = node.children.get(part)
            if k == len(parts) - 1:
                if known is None:
                    known = node.children[part] = Node(kind)
                elif known.kind is None:
                    raise ValueError(f"{path!r} is an object with filtered fields")
                elif known.kind != kind and "any" not in (known.kind, kind):
                    raise ValueError(f"{path!r} is {known.kind}, not {kind}")
                elif known.kind == "any":
                    known.kind = kind
            elif known is None:
                known = node.children[part] = Node()
            node = known
        return node

    def _filter(self, path: str, kind: str, predicate) -> JsonQuery:
        self._leaf(path, kind).predicates.append(as_predicate(predicate))
        return self

    def add_string_filter(self, path: str, predicate) -> JsonQuery:
        return self._filter(path, "string", predicate)

    def add_integer_filter(self, path: str, predicate) -> JsonQuery:
        return self._filter(path, "int", predicate)

    def add_boolean_filter(self, path: str, predicate=lambda c: c) -> JsonQuery:
        return self._filter(path, "bool", predicate)

    def add_exists(self, path: str) -> JsonQuery:
        """The path must be present; an explicit JSON null counts as present."""
        self._leaf(path, "any").exists = True
        return self

    def add_projection(self, path: str, kind: str = "string", alias: str | None = None) -> JsonQuery:
        """string, int, bool, double or an array type such as array<string>; the value is returned."""
        self._leaf(path, kind)
        self.projections[alias or path.replace(".", "_")] = path
        return self

    def schema(self) -> T.StructType:
        return self.root.struct()

    def _value(self, record: Column, path: str) -> tuple[Column, Node]:
        col, node = record, self.root
        for part in path.split("."):
            col, node = col.getField(part), node.children[part]
        if node.kind == "string":
            col = F.when(F.schema_of_variant(col) == "STRING", F.try_variant_get(col, "$", "string"))
        elif node.kind.startswith("array"):
            col = F.try_variant_get(col, "$", node.kind if "<" in node.kind else "array<variant>")
        return col, node

    def _leaves(self, node: Node | None = None, path: tuple = ()):
        node = node or self.root
        for k, child in node.children.items():
            if child.children:
                yield from self._leaves(child, (*path, k))
            else:
                yield (*path, k), child

    def condition(self, record: Column) -> Column:
        """True only where every path's checks hold. No paths at all: never."""
        checks = []
        for path, node in self._leaves():
            value, _ = self._value(record, ".".join(path))
            checks += [p(value) for p in node.predicates]
            if node.exists:
                raw = reduce(lambda c, part: c.getField(part), path, record)
                checks.append(raw.isNotNull())
        if not checks:
            return F.lit(bool(self.projections))
        return reduce(lambda a, b: a & b, checks)

    def columns(self, record: Column) -> list[Column]:
        return [self._value(record, path)[0].alias(name) for name, path in self.projections.items()]

    def literals(self) -> list[str]:
        """What every matching record must hold, unless escapes hide it (the raw filters guard that)."""
        return [p.literal for _, n in self._leaves() for p in n.predicates if n.kind == "string" and p.literal and is_sound_token(p.literal)]

    def path_tokens(self) -> list[str]:
        """The quoted keys on the way to each leaf, also required; many records share them."""
        return list(dict.fromkeys(f'"{k}"' for path, _ in self._leaves() for k in path if is_sound_token(k)))

    def describe(self) -> str:
        lines: list[str] = []

        def walk(node: Node, depth: int) -> None:
            for k, child in node.children.items():
                checks = [p.name for p in child.predicates] + ["exists"] * child.exists
                lines.append("  " * depth + f"{k} (type={child.kind or 'object'})" + (f" [{', '.join(checks)}]" if checks else ""))
                walk(child, depth + 1)

        walk(self.root, 0)
        return "\n".join(lines)
