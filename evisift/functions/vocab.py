"""Word lists and constants that results depend on."""

# Disease keywords, first hit wins.
DISEASE_KEYWORDS = ["SFTS", "SFTSV", "severe fever with thrombocytopenia", "传染病", "流感", "COVID", "SARS"]

# Paragraph cue -> paragraph type, priority order.
PARAGRAPH_CUES = [
    ("abstract", "abstract"),
    ("introduction", "introduction"),
    ("method", "methods"),
    ("result", "results"),
    ("conclusion", "conclusion"),
]

# First word of a section heading -> section type.
SECTION_KEYWORDS = {
    "abstract": "abstract",
    "summary": "abstract",
    "introduction": "introduction",
    "background": "introduction",
    "methods": "methods",
    "method": "methods",
    "materials": "methods",
    "experimental": "methods",
    "results": "results",
    "result": "results",
    "findings": "results",
    "discussion": "discussion",
    "conclusions": "conclusion",
    "conclusion": "conclusion",
    "concluding": "conclusion",
    "references": "references",
    "bibliography": "references",
    "literature": "references",
    "acknowledgements": "acknowledgements",
    "acknowledgments": "acknowledgements",
    "acknowledgement": "acknowledgements",
    "acknowledgment": "acknowledgements",
    "funding": "acknowledgements",
    "conflicts": "acknowledgements",
    "competing": "acknowledgements",
    "declaration": "acknowledgements",
    "ethics": "acknowledgements",
    "data": "acknowledgements",
    "supporting": "supplementary",
    "supplementary": "supplementary",
    "appendix": "supplementary",
}

# DOI capture and lines that cannot be a title.
DOI_CAPTURE = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"
TITLE_NOISE_LINE = (
    r"(?i)^(\s*\d+\s*$|.*\b(vol\.?|issue|pages?|proceedings)\b|.*\b(received|accepted|published|copyright)\b"
    r"|.*@.*\.(com|edu|org|cn)|\s*https?://\S+\s*$)"
)
