"""Query verbs, joins, resolution and maintenance operators."""
