"""Thresholds of the engine in one place; every operator takes overrides."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # Thresholds that decide results.
    dedup: float = 0.88
    cluster: float = 0.75
    chunk_duplicate: float = 0.85
    merge_low: float = 0.65
    merge_high: float = 0.84
    auto_merge: float = 0.75
    contradiction_low: float = 0.45
    strong_contradiction: float = 0.55
    shared_question: float = 0.5
    proposition: float = 0.78
    jaccard_floor: float = 0.1
    strong_alignment: float = 0.3
    orphan_edges: int = 20
    orphan_sources: int = 2
    orphan_cosine: float = 0.32
    orphan_lexical: float = 0.06
    max_themes: int = 40
    max_ranked: int = 20
    exact_partition: int = 12
    min_quote: int = 20
    fuzzy_quote: float = 0.45
    entity_floor: float = 0.15
    generic_ceiling: float = 0.90
    specificity_mismatch: float = 0.4
    chunk_chars: int = 4000
    body_chars: int = 50_000
    context_chars: int = 250
    relate_weight: float = 0.6
    relate_cap: int = 50
    relate_batch: int = 25
    structure_batch: int = 6
    max_presuppositions: int = 3
    high_weight: float = 0.7
    lexical_grounding: float = 0.18
    paragraph_words: int = 25


DEFAULT = Thresholds()

# Closed sets of the data model.
NODE_TYPES = ("claim", "evidence", "presupposition", "question", "gap")
CLAIM_ALIASES = ("rebuttal", "counterargument", "refutation", "objection", "response", "argument")
RHETORICAL = ("dismissal", "rhetorical", "ad_hominem", "credibility_attack", "straw_man")
RELATION_TYPES = ("presupposes", "supports", "contradicts", "undermines", "elaborates", "qualifies", "depends_on", "quantitative_divergence", "self_inconsistency", "weak_contradicts")
RELATE_TYPES = ("supports", "contradicts", "requires", "explains", "undermines")
CONFLICT_TYPES = ("contradicts", "undermines")
PROPOSITION_TYPES = ("contradicts", "weak_contradicts", "quantitative_divergence", "self_inconsistency")
STATUSES = ("contested", "contested_weak", "well_established", "supported", "single_source")
ROLES = ("primary_research", "review", "commentary", "debate_transcript", "judge_decision", "rebuttal", "unknown")
SCORE_WORDS = {"very_high": 0.9, "high": 0.85, "medium": 0.65, "hedged": 0.55, "moderate": 0.6, "low": 0.4, "very_low": 0.3}
TRUST_TYPES = {"text": "essay_reflection", "pdf": "peer_reviewed", "video": "debate_transcript", "audio": "debate_transcript", "web": "journalism"}
SECTION_HINTS = {
    "results": "empirical_finding — higher evidential weight",
    "findings": "empirical_finding — higher evidential weight",
    "methods": "methodological — describes procedure not finding",
    "limitations": "constrained — author flags scope restriction",
    "discussion": "interpretive — author inference, not raw data",
    "introduction": "framing — may contain reported_speech of others",
    "background": "framing — may contain reported_speech of others",
    "conclusion": "synthesis — interpretive, check for overgeneralization",
    "abstract": "summary — verify claims against body sections",
}
NO_HINT = "general — no specific epistemic weight"
BLOCK_PHRASES = ("enable javascript", "javascript is required", "please enable js", "you need to enable javascript", "subscribe to read", "this content is for subscribers", "access this article", "sign in to read", "create a free account", "403 forbidden", "429 too many")
# Words left out of token sets.
STOP_WORDS = (
    "that this with from have been were their there which would could should about into than then when what whether because these those other after before such only also more most some them they"
).split()
# Words left out of report paragraphs.
REPORT_STOP_WORDS = (
    "a an the of and or but if then so as is are was were be been being have has had do does did to from in on at by for with without about into onto upon "
    "through during over under above below this that these those it its their there here when where which who whom whose what why how all any some no not "
    "only also more most less many few much such same other another both either neither each every can could may might must shall should will would"
).split()
# Words left out of stance keywords.
STANCE_STOP_WORDS = (
    "about after also among based been being between both could does each even from have here into likely more most much must only other over same some such "
    "than that their them then there these they this those through under very were what when where which while with would your"
).split()
# Markers of a paper.
PAPER_MARKERS = ("abstract", "materials and methods", "study question", "summary answer", "study design", "participants", "introduction", "supplementary", "main results")
TOKEN_PRICES = {"fast": (0.25, 1.25), "smart": (3.0, 15.0)}
SEVERITY_WEIGHT = {"FATAL": 3, "MAJOR": 2, "MINOR": 1}
# Terms that tell the kind of an inquiry.
PROBABILITY_TERMS = ("prior ", "posterior", "bayesian", "likelihood ratio", "odds ratio", "base rate", "conditional probability")
# Terms that tell the kind of an inquiry.
DEBATE_TERMS = (" versus ", " vs ", "more likely", "odds", "prior ", "posterior")
# Terms that tell the kind of an inquiry.
METHOD_TERMS = ("sample", "cohort", "method", "statistical", "experiment", "trial", "replication", "sequencing", "transcriptom")
# Content types that are papers.
PAPER_KINDS = ("paper", "preprint", "research", "journal", "dataset")
# Tiers of the badges by what they show.
BADGES = {
    "epistemic": {"well_established": "ok", "supported": "ok", "contested": "warn", "single_source": "", None: "muted"},
    "audit": {"declared": "ok", "not_declared": "warn", "red_flag": "danger", "not_applicable": "muted", None: "muted"},
    "importance": {"latent_gem": "warn gem", "central": "ok", "contributory": "muted", "peripheral": "muted", None: ""},
    "grounding": {"from_evidence": "ok", "grounded": "ok", "from evidence": "ok", None: "warn"},
    "vulnerability": {"high": "danger", "medium": "warn", "low": "muted", None: "muted"},
    "leverage": {"high": "ok", "medium": "warn", "low": "muted", None: "muted"},
}
