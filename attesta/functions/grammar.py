"""Fixed values of the formats that are read: patterns, word lists and limits.

They decide what counts as a citation, a heading, a block or a usable document, so
they must be as they are for results to agree with manifests and reports made
elsewhere. The logic that uses them is in the readers and expressions. Patterns are
used by Java's engine (with `(?U)` in front) and by Python's alike.
"""

from __future__ import annotations

# Citations.
PANDOC_CITATION = r"(?<![\w@.])@([A-Za-z0-9][A-Za-z0-9_.:+\-]*)"
PANDOC_CLOSING = ".,;:!?"
LATEX_CITATION = r"\\(?:cite|citep|citet|autocite|parencite|textcite)\*?(?:\s*\[[^\]]*\])*\s*\{([^{}]*)\}"
VISIBLE_CITATION = r"\[@[^\]]+\]|\([^()\n]*\b(?:18|19|20)\d{2}[a-z]?\b[^()\n]*\)"

# Markdown and LaTeX lines.
DOCUMENT_SCOPE = "(document scope)"
MARKDOWN_HEADING = r"\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
HEADING_ATTRIBUTES = r"\s*\{[^{}]*\}\s*$"
MARKDOWN_FENCE = r"\s*(`{3,}|~{3,})"
YAML_MAPPING = r"\s*[A-Za-z][A-Za-z0-9_-]*\s*:"
YAML_OPENING, YAML_CLOSING = "---", ("---", "...")
LATEX_SECTION = r"\s*\\(?:part|chapter|section|subsection|subsubsection)\*?(?:\[[^\]]*\])?\{([^{}]*)\}"

# HTML elements. Text blocks, boxes that part blocks, headings, and what is never shown.
HTML_BLOCKS = frozenset("caption dd dt h1 h2 h3 h4 h5 h6 p li blockquote pre td th".split())
HTML_BOXES = frozenset("article div dl figure figcaption main section table tbody tfoot thead tr".split())
HTML_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HTML_EXCLUDED = frozenset("head script style nav template".split())
HTML_VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())

# BibTeX.
BIBTEX_SKIPPED = ("comment", "preamble", "string")
TEX_ESCAPABLE = "$%&_#'\"`^~="

# Limits of Word packages, and marks of badly extracted PDF text.
OOXML_ENTRIES, OOXML_ENTRY_BYTES, OOXML_TOTAL_BYTES, OOXML_RATIO = 10_000, 50 << 20, 200 << 20, 100
PDF_PAGE_CHARACTERS, PDF_BROKEN_SHARE, PDF_BROKEN = 100, 0.01, "�"

# The reference manager's local service.
LIVE_BASE, LIVE_TIMEOUT, LIVE_LIMIT = "http://127.0.0.1:23119", 5.0, 25
LIVE_HEADERS = {"Accept": "application/json", "Zotero-API-Version": "3"}
LIVE_AUTHORS = ("author", "bookAuthor")
LIVE_KEY_LINE = r"(?im)^\s*Citation Key\s*:\s*(\S+)\s*$"
