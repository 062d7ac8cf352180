"""The public callables in one place."""

from .operators import blockmax, vectorindex
from .operators.chunking import child_chunks, headings, numbered_sections, recursive_split, route, section_chunks, sections
from .operators.context import answered_question, history, render, select_context
from .operators.fusion import debug_lists, fuse, hybrid, nested, parents_of, with_origin
from .operators.lexical import Bm25Index
from .operators.lexicon import counts as lexicon_counts
from .operators.lexicon import hits as lexicon_hits
from .operators.logs import diagnostics, feedback_rows
from .operators.metadata import categories, display, doc_key, enrich, front_matter, source_class
from .operators.profile import Lexicon, doc_institutions, profile
from .operators.rerank import Weights, rerank, score
from .operators.vector import embed, hashing_embedder, top_k
from .plans.answer import Answers, answer, rewritten
from .plans.index import Found, HybridIndex, SplitIndex, build, build_or_load, build_or_load_split, build_split, load, load_split, parent_table
from .plans.refresh import compact, refresh
from .sources.files import corpus_header, knowledge_markdown, merge_by_title, page_texts, read_text, scan_texts
from .sources.mdfiles import export_markdown
from .sources.sinks import append_diagnostics, append_feedback, preview, write_chunks, write_markdown

__all__ = [n for n in dir() if n[0] != "_" and n not in ("operators", "plans", "sources")]
