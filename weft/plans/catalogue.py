"""The queries of the graph operators, bound to the test tables."""

from weft.plans import q_api, q_build, q_graph, q_history, q_text

_PARTS = (q_graph, q_history, q_text, q_build, q_api)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
