"""quire: document refinement on Spark.

One row is one document.  Deterministic clean-up steps are ``Column`` expressions
(``quire.operators``), composed into a shuffle-free pipeline (``quire.plans``);
extraction and model stages are pluggable Arrow adapters (``quire.sources``).
"""

from quire.operators.bibliography import process_bibliography
from quire.operators.citations import process_citations
from quire.operators.cleanup import cleanup_text
from quire.operators.enrich import enrichments
from quire.operators.figures import process_figures
from quire.operators.sections import process_sections
from quire.plans.batch import run_batch
from quire.plans.convert import Options, convert, enrich, parsed
from quire.plans.pipeline import process_markdown
from quire.plans.postprocess import agent_pass, postprocess, write_back
from quire.plans.publications import run_publications
from quire.sources.files import cleanup_agent, convert_documents

__version__ = "0.2.0"

__all__ = [
    "Options", "agent_pass", "cleanup_agent", "cleanup_text", "convert", "convert_documents", "enrich", "enrichments", "parsed", "postprocess", "process_bibliography", "process_citations", "process_figures", "process_markdown", "process_sections", "run_batch", "run_publications", "write_back",
]
