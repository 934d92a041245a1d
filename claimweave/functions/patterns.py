"""Regular expressions of the text operators, in Java syntax."""

# What marks a quote as index debris rather than evidence. start: anchored at the beginning of the quote.
TOC_DOTS = r"(?m)(?:\.\s*){3,}\s*\d+\s*$"
TOC_EMBEDDED = r"(?i)\d+(?:\.\d+)+\s+\w[^.\n]{5,90}(?:\.\s*){3,}\s*\d+"
TOC_SECTION = r"(?m)^\s*\d+(?:\.\d+)+\s+[A-Za-z][^.\n]{5,100}\.\s*$"
PAGE_SECTION = r"(?m)\A\s*\d+\s*(?:\n\s*)?\d+(?:\.\d+)+\s+[A-Za-z].{5,90}\.\s*$"
JUNK_ANYWHERE = (
    r"\b[A-Za-z]{4,}\d{1,2}\b",
    r"(?i)\n\d{1,2}\n(?:ie,|Being off-topic|[A-Z][a-z]{3,})",
    r"(?i)known\d+\s+to\b",
    r"(?i)\A0 people are known\b",
    r"(?i)(?:\d+(?:\.\d+)+\s+[^.\n]{4,50}\s*){2,}(?:\.\s*){2,}",
    r"(?im)^The lack of infected animals\s*\nScott quotes[^.]{10,200}:\s*$",
    r"(?im)\A\s*(?:\d+(?:\.\d+)+\s+)?(?:Covid testing of|Locating sars-cov-2|Correlations between)[^.!?]{4,90}\s*$",
    r"(?i)\A(?:ated|nal|ing|tion|ions|ment|ally)\s",
)
# A row of dots; the id in the address of a video.
ELLIPSIS = r"(?:\.\s*){3}"
# A paragraph that is a section header.
SECTION = (
    r"(?i)^\s*(abstract|introduction|background|methods?|materials?\s*(?:and\s+methods?)?|results?|findings?|discussion|conclusions?|limitations?|"
    r"supplementary|acknowledgements?|references?|bibliography|\d+[\.\s]+(?:introduction|methods?|results?|discussion|conclusion))\s*$"
)
# Cited ids in a report.
CITED = (r"\b(gap_[a-f0-9]{8})\b", r"\b(claim_[a-f0-9]{8})\b", r"\b(crux_[a-z0-9_]+)\b", r"\b(chain_[a-z0-9_]+)\b", r"\b(theme_\d{2})\b", r"(?<![a-z])([a-f0-9]{8})(?![a-z0-9])")
YOUTUBE = r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})"
# Words that make an external reference specific, or vague.
REFERENCE_MARK = r"\d{4}|edition|ed\.|vol\.|chapter|section|iso |who |cohen"
REFERENCE_YEAR = r"\d{4}|2nd|3rd|edition|ed\."
REFERENCE_VAGUE = ("standard practice", "field convention", "textbook", "generally accepted", "widely used", "common practice")
DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form", "button", "noscript")
# Section starts and ends of methodology extraction.
ABSTRACT_START = r"(?im)^(?:#+\s*)?(?:abstract\b|study\s+question\b|summary\s+answer\b)"
METHODS_START = r"(?im)^(?:#+\s*)?(?:materials?\s+and\s+methods?|methods?\b|patients?\s+and\s+methods?|study\s+design|experimental\s+(?:design|procedures?)|participants?\s+and\s+methods?|participants?/materials|setting,\s+methods?)\b"
METHODS_END = r"(?im)^(?:#+\s*)?(?:results?|discussion|conclusions?|acknowledg|references?|supplementary)\b"
RESULTS_START = r"(?im)^(?:#+\s*)?(?:main\s+results|results?\b|findings\b|key\s+findings)\b"
RESULTS_END = r"(?im)^(?:#+\s*)?(?:discussion|conclusions?|acknowledg|references?|funding|competing\s+interests?|limitations)\b"
DEBATE_WORDS = (
    r"(?i)\b(?:bayesian|base\s+rate|likelihood\s+ratio|prior\s+probability|methodolog|conditional\s+probability|bayes\s+factor|reasoning|calculation|assumption|"
    r"sample\s+size|control\s+group|confounder|exclusion\s+criteria|irb|ethics|cohort|participants?|power\s+analysis|randomi[sz]ed|placebo|blinded|"
    r"statistical\s+(?:method|analysis|test)|confidence\s+interval|p[\s-]?value)\b"
)
