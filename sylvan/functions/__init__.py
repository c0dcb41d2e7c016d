"""Scalar functions as Column expressions, for use in any DataFrame."""

from ..operators.bindings import base_type, ident_name, ident_rule, pascal_name, type_name
from ..operators.compdb import kept_flags, matches_any, quoted, resolved, substituted
from ..operators.graph import decl_iri, escaped
from ..operators.jobs import language_number, render_spec, tail_lines
from ..operators.text import whole_word
from ..operators.textir import argument_text, normal_type, split_arguments, within

__all__ = [
    "argument_text", "base_type", "decl_iri", "escaped", "ident_name", "ident_rule", "kept_flags", "language_number", "matches_any", "normal_type", "pascal_name",
    "quoted", "render_spec", "resolved", "split_arguments", "substituted", "tail_lines", "type_name", "whole_word", "within",
]
