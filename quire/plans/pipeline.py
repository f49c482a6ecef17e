"""The whole refinement of a markdown document as one expression."""

from __future__ import annotations

from pyspark.sql import Column

from quire.functions.text import let
from quire.operators.bibliography import process_bibliography
from quire.operators.citations import process_citations
from quire.operators.cleanup import cleanup_text
from quire.operators.figures import process_figures
from quire.operators.sections import process_sections


def process_markdown(c: Column, files: Column) -> Column:
    """Sections, citations, figures, bibliography and clean-up, in this order.

    Each step is bound once, so the plan is a single projection without exchange."""
    return let(process_sections(c), lambda a: let(process_citations(a), lambda b: let(process_figures(b, files), lambda d: let(process_bibliography(d), cleanup_text))))
