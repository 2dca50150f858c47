"""Schemas of the fact tables. Every pass takes and returns DataFrames of these columns.

functions: file_path, name, language, start_line, end_line, line_count, complexity, is_exported,
           is_default_export, is_async, parameters, calls, fn_ord (order within the file)
calls:     file_path, language, caller (id of the calling function, null at module level), callee
imports:   file_path, source, symbols, is_relative
files:     file_path, language, content, line_count
touches:   commit_hash, author_name, author_email, date, file_path, ord (order in the log)
"""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FUNCTION = _struct(
    name=_s, start_line=_i, end_line=_i, parameters=T.ArrayType(_s), is_exported=_b, is_default_export=_b, is_async=_b,
    calls=T.ArrayType(_s), complexity=_i, line_count=_i,
)
CLASS = _struct(name=_s, start_line=_i, end_line=_i, extends=_s, implements=T.ArrayType(_s), is_exported=_b)
IMPORT = _struct(source=_s, symbols=T.ArrayType(_s), is_relative=_b)
PARSED = _struct(
    file_path=_s, language=_s, line_count=_i, complexity=T.DoubleType(), explanation=_s, exports=T.ArrayType(_s),
    module_level_calls=T.ArrayType(_s), functions=T.ArrayType(FUNCTION), classes=T.ArrayType(CLASS), imports=T.ArrayType(IMPORT),
)
