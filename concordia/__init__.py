"""concordia: a PySpark engine that audits documented rules against observed states.

Text corpora become tables (units, parameters, rules, paths); rules are broken into
typed literals and clauses; a rule is checked against every observed path of its unit
with joins and group-bys; verdicts are scored against an oracle.
"""

__version__ = "0.1.0"
