"""Schemas of source files and of their facts."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LIST = T.ArrayType(_S)
_COUNTS = T.MapType(_S, _L)

#: Input of extraction.  ``display`` is the path that reports show, ``below`` the path below the scan root,
#: ``package`` the Python package; ``alias`` and ``orm`` are TypeScript settings.
SOURCE = _struct(lang=_S, path=_S, display=_S, below=_S, package=_S, source=_S)

FUNCTION = _struct(
    name=_S, qualname=_S, line=_L, end_line=_L, line_count=_L, complexity=_L, cognitive=_L, nesting=_L, params=_L, clone_hash=_S, exact_hash=_S, is_test=_B, is_method=_B, decorators=_LIST,
    exported=_B, is_component=_B, props=_LIST, hooks=_LIST, is_unsafe=_B, is_async=_B, visibility=_S, parent_type=_S,
)
TYPE = _struct(name=_S, kind=_S, line=_L, line_count=_L, methods=_L, properties=_L, fields=_L, exported=_B, has_heritage=_B, has_generics=_B, derives=_LIST, visibility=_S, decorators=_LIST)
TRAIT = _struct(name=_S, line=_L, visibility=_S)
IMPORT = _struct(source=_S, target=_S, specifiers=_LIST, is_internal=_B, line=_L)
FINDING = _struct(family=_S, kind=_S, line=_L, name=_S, detail=_S)
ROUTE = _struct(method=_S, path=_S, handler=_S, line=_L, dependencies=_LIST)
MARKER = _struct(tag=_S, line=_L)
RULE = _struct(family=_S, rule=_S)

FACTS = _struct(
    lang=_S, path=_S, display=_S, module=_S, line_count=_L, is_test=_B, parse_error=_S,
    functions=T.ArrayType(FUNCTION), types=T.ArrayType(TYPE), traits=T.ArrayType(TRAIT), imports=T.ArrayType(IMPORT), exports=_LIST, star_sources=_LIST,
    findings=T.ArrayType(FINDING), routes=T.ArrayType(ROUTE), counters=_COUNTS, allow_lints=_COUNTS, derives=_COUNTS, markers=T.ArrayType(MARKER), rules=T.ArrayType(RULE),
)
