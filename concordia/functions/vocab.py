"""Vocabularies and constants the results depend on.

FIXED VALUES — these must equal the audited tool's values for identical results; they
are stated plainly, in their natural order, and are exposed as parameters of the
operators that use them (callers may pass their own lists).
"""
from __future__ import annotations

# FIXED VALUES: words that mark a rule as being about (non-)existence of a parameter.
FUZZY_NONEXISTENCE = ("ignore", "no effect", "unused", "override")
FUZZY_EXISTENCE = ("specify", "specified", "have an effect", "significant", "exist", "existed", "used")

# FIXED VALUES: quoted words that make a rule undecidable.
UNSOLVED_WORDS = (
    "float32", "float64", "int32", "int64", "'int'", '"int"', "*", "**", ".", "..", "(", ")",
    "[", "]", "{", "}", "/", "sparse_matrix", "dense_matrix", "time_elapsed", "print",
    "dense_array", "sparse_array", "transformer_name", "defined", "stderr", "stdout",
    "callable", "classifier", "Classifier",
)

# FIXED VALUES: characters that make a literal's name or string value unusable.
SYMBOL_CHARS = ("[", "]", "*", "{", "}")

# FIXED VALUES: operator feature vectors for the operator part of literal similarity.
OPERATOR_VECTORS = {
    "<": (1, 0, 0, 1, 0),
    ">": (1, 0, 1, 0, 0),
    "<=": (1, 1, 0, 1, 0),
    ">=": (1, 1, 1, 0, 0),
    "=": (0, 1, 0, 0, 0),
    "!=": (0, 1, 0, 0, 1),
}

# FIXED VALUES: similarity weights (name, operator, value) and the gate band.
SIM_NAME_WEIGHT = 0.25
SIM_OP_WEIGHT = 0.5
SIM_VALUE_WEIGHT = 0.25
SIM_GATE_LOW = 0.85
SIM_GATE_HIGH = 1.0
NEGATED_SLOT_FACTOR = 0.85

# FIXED VALUES: name prefixes of opaque values (always-true literals).
OPAQUE_PREFIXES = ("call_", "list_", "dict_")

# Operator negation (used to push NOT into literals) and mirror (numeric left side).
NEGATE_OP = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
MIRROR_OP = {">": "<", "<": ">", ">=": "<=", "<=": ">="}

# FIXED VALUES: docstring section headers (numpy style): section -> kind.
NUMPY_HEADERS = {
    "Parameters": "param", "Attributes": "attr",
    "Returns": None, "return": None, "Examples": None, "Example": None, "Yields": None,
    "Notes": None, "See Also": None, "Raises": None, "References": None,
}
# FIXED VALUES: docstring section headers (google style).
GOOGLE_HEADERS = {
    "Args:": "param", "Attributes:": "attr",
    "Returns:": None, "returns": None, "Call Args:": None, "Output:": None, "Examples:": None,
    "Example:": None, "Raises:": None, "Note:": None, "References:": None,
    "Call arguments:": None, "Input shape:": None, "Output shape:": None,
}
GOOGLE_SKIP_NEXT = ("Raises:", "Note:")
