"""Word lists, patterns and thresholds that results depend on."""

HEDGING = "perhaps might may could possibly probably seems appears arguably conceivably suggests roughly somewhat sometimes often usually believe assume guess likely unlikely".split()
ABSOLUTE = "always never absolutely definitely undoubtedly certainly obviously undeniably everyone nobody impossible proven fact guaranteed unquestionably".split()
NEGATION = "not no none cannot neither nor nowhere nothing never hardly barely scarcely".split()
VAGUE = "several many some various numerous few multiple certain significant substantial considerable roughly approximately around".split()
MODAL = "could would should might may can will shall must ought".split()
SUPERLATIVE = "best worst most least greatest largest smallest highest lowest fastest strongest".split()
SELF_REFERENCE = ["i believe", "in my opinion", "i think", "it seems to me", "as far as i know", "to the best of my knowledge", "i would say", "from my perspective"]

FUNCTION_WORDS = sorted(
    "the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will would could should may might shall can that this these those it its i you he she we they me him her us them".split()
)
FILLERS = sorted([*"like basically literally actually honestly seriously anyway whatever stuff things right".split(), "kind of", "sort of", "you know", "i mean"])
TRANSITIONS = sorted("however therefore furthermore moreover additionally consequently nevertheless nonetheless thus hence although despite meanwhile subsequently".split())
COMMON_ENGLISH = "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me when make".split()
STYLE_STOP = "the a an and or but of to in on for with at by from as is are was were be been being it its this that these those i you he she we they".split()
REASONING_STOP = (
    "a an the and or but if in on at to for of with by from is was are were be been being have has had do does did will would could should may might shall can need not no nor so as it its this that these those "
    "i me my we our you your he him his she her they them their what which who whom when where how why all each every both few more most other some such than too very just about above after again also any because "
    "before between during into only over same then there through under until up while"
).split()

#: Patterns are for lower-cased text; (?U) makes \b, \w and \s Unicode-aware.
MARKERS = {
    "consequence_density": r"\b(?:as\s+a\s+result|consequently|accordingly|therefore|thus|hence)\b",
    "causal_density": r"\b(?:due\s+to|owing\s+to|given\s+that|because|since)\b",
    "contrast_density": r"\b(?:on\s+the\s+other\s+hand|nevertheless|nonetheless|however|although|despite)\b",
    "sequence_density": r"\b(?:first(?:ly)?|second(?:ly)?|third(?:ly)?|finally|subsequently|initially)\b",
    "backtracking_density": (
        r"\b(?:wait\s*[,.\-!…]+\s*wait|but\s+wait|let(?:'s|\s+us|\s+me)\s+re-?evaluate|on\s+(?:the\s+)?second\s+thought"
        r"|(?:no|actually)[,\s]+that(?:'s|\s+is)\s+(?:wrong|incorrect|not\s+(?:right|correct))|i\s+made\s+(?:an?\s+)?(?:error|mistake)|let\s+me\s+reconsider|this\s+(?:reasoning|approach)\s+is\s+(?:not\s+)?correct)\b"
    ),
    "cot_scaffold_density": (
        r"\b(?:let(?:'s|\s+me)\s+think|step\s+by\s+step|let(?:'s|\s+me)\s+break\s+(?:this|it)\s+down|(?:first|now)\s+(?:i|we)\s+need\s+to|working\s+through|to\s+solve\s+this|the\s+key\s+insight|step\s+\d+"
        r"|from\s+this\s+we\s+can\s+conclude|it\s+follows\s+that|reasoning\s+through|analyzing\s+this)\b"
    ),
    "intuition_leap_density": r"\b(?:obviously|clearly|of\s+course|naturally|it\s+goes\s+without\s+saying|needless\s+to\s+say|surely)\b",
}
NUMBER = r"\b\d+\.?\d*\b"
SPECIFIC_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}|(?:19|20)\d{2})\b"
VAGUE_TIME = r"\b(?:recently|in\s+recent\s+(?:years|months|times)|for\s+(?:some|a long)\s+time|historically|in\s+the\s+past|nowadays|these\s+days)\b"
GUARDED_STOP = r"(?:\.{3,}|[!?]+|(?<!Mr)(?<!Mrs)(?<!Dr)(?<!vs)(?<!St)(?<![A-Z])(?<!\d)\.(?!\d)(?![a-z]))\s*"

#: Ordered tag rules over whole tokens; what none matches is a NOUN.
TAGS = [
    ("am|is|are|was|were|be|been|being", "AUX"),
    ("will|would|could|should|may|might|shall|can|must", "AUX"),
    ("the|a|an|this|that|these|those|my|your|his|her|its|our|their", "DET"),
    ("and|but|or|nor|for|yet|so", "CCONJ"),
    ("although|because|since|while|unless|if|when|as|than", "SCONJ"),
    ("in|on|at|to|for|of|with|by|from|about|into|through|during|before|after", "ADP"),
    ("i|you|he|she|it|we|they|me|him|her|us|them|myself|yourself|himself|herself|itself", "PRON"),
    (r"\w+ly", "ADV"),
    (r"\w+(ing|ed)", "VERB"),
    (r"\w+(tion|ness|ment|ity|ism|age|ance|ence|ship)", "NOUN"),
    (r"\w+(ful|less|ous|ive|able|ible|al|ic)", "ADJ"),
    (r"\d+", "NUM"),
    (r"[^\w\s]+", "PUNCT"),
]

#: Look-alikes of Latin letters: Cyrillic upper and lower case, then Greek.
CONFUSABLE_FROM = "АВСЕНКМОРТХУІЈЅԚԜЃ" + "аеосрхукмтнвіјѕԛԝѐг" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "αονρτυικμχεϲѵ"
CONFUSABLE_TO = "ABCEHKMOPTXYIJSQWG" + "aeocpxykmthbijsqwer" + "ABEZHIKMNOPTYX" + "aovptuikuxecv"
ZERO_WIDTH = "​‌‍⁠﻿᠎­"
ZERO_WIDTH_ATTRIBUTION = "​‌‍‎‏﻿­"

LABELS_V6 = "Human Claude DeepSeek Gemini GPT Grok Mistral".split()
LABELS_V7 = "Human GPT Claude Gemini Grok Mistral DeepSeek".split()
#: First key that a raw label contains decides.
FAMILIES_V6 = [("human", "Human"), ("gpt", "GPT"), ("deepseek", "DeepSeek"), ("claude", "Claude"), ("gemini", "Gemini"), ("grok", "Grok"), ("mistral", "Mistral")]
FAMILIES_V7 = [
    ("human", "Human"), ("gpt", "GPT"), ("openai", "GPT"), ("davinci", "GPT"), ("claude", "Claude"), ("anthropic", "Claude"), ("gemini", "Gemini"), ("bard", "Gemini"), ("palm", "Gemini"),
    ("grok", "Grok"), ("xai", "Grok"), ("mistral", "Mistral"), ("mixtral", "Mistral"), ("deepseek", "DeepSeek"),
]
MEDIAN_CLASS_COUNT = 382_720
#: profile: least P(AI), agreement and margin, band of P(Human).
PROFILES = {"strict": (0.75, 1.0, 0.25, 0.20, 0.55), "moderate": (0.60, 0.67, 0.15, 0.25, 0.50), "permissive": (0.45, 0.33, 0.10, 0.30, 0.45)}

RISK_WEIGHTS = {"lexical_risk": 0.10, "entity_anomaly": 0.10, "entropy": 0.05, "semantic_incoherence": 0.25, "vagueness": 0.20, "repetition": 0.10, "structural_anomaly": 0.10, "imprecision": 0.10}
REASONING_WEIGHTS = {
    "backtracking_density": 0.26, "cot_scaffold_density": 0.23, "consequence_density": 0.09, "causal_density": 0.07, "sequence_density": 0.07,
    "contrast_density": 0.05, "word_entropy_normalised": 0.07, "type_token_ratio": 0.05, "paragraph_length_cv": 0.03,
}
REASONING_THRESHOLDS = {
    "type_token_ratio": (0.35, 0.72), "mean_sentence_length": (12.0, 26.0), "std_sentence_length": (4.0, 14.0), "mean_word_length": (3.8, 5.8), "punctuation_ratio": (0.02, 0.06), "stopword_ratio": (0.30, 0.52),
    "consequence_density": (0.02, 0.06), "causal_density": (0.02, 0.07), "contrast_density": (0.02, 0.06), "sequence_density": (0.01, 0.05), "backtracking_density": (0.01, 0.07), "cot_scaffold_density": (0.02, 0.10),
    "intuition_leap_density": (0.01, 0.04), "paragraph_length_cv": (0.18, 0.55), "word_entropy_normalised": (0.68, 0.90),
}

#: Training noise of the first ensemble: share of texts, of words, of words that take in the next, and letters a word needs.
AUGMENT_V6 = {"apply": 0.7, "chars": 0.1, "merge": 0.05, "least": 5}

#: Where the displayed level of a style metric turns medium and high.
STYLE_LEVELS = {
    "burstiness": (0.15, 0.30), "lexical_diversity": (0.40, 0.70), "avg_sentence_length": (12.0, 22.0), "sentence_length_variance": (20.0, 80.0), "avg_word_length": (3.8, 5.5),
    "vocabulary_richness": (0.40, 0.70), "hapax_legomena_ratio": (0.30, 0.60), "rare_word_ratio": (0.05, 0.20), "comma_rate": (0.02, 0.06), "complex_sentence_ratio": (0.20, 0.50),
}

#: What a report says of a sentence from this score on, and of its indicators.
SENTENCE_TEXTS = [
    (0.85, "This sentence has a very high AI probability score, strongly suggesting it was machine-generated."),
    (0.65, "This sentence shows elevated AI indicators, suggesting it may be AI-generated or heavily AI-assisted."),
    (0.45, "This sentence falls in the uncertain zone — it could be either human-written or AI-generated."),
    (0.25, "This sentence shows mostly human-like characteristics with some mild AI indicators."),
    (0.0, "This sentence appears strongly human-written with natural language patterns."),
]
INDICATORS_TEXT = " Key signals detected: %s."
NO_INDICATORS_TEXT = " No specific AI indicator words were detected in this sentence; the score is based on overall text context."

#: Statistics of a text of which nothing else is known.
DEFAULT_STATS = {"ppl": 50.0, "burstiness": 0.1, "entropy": 0.0, "lexical_diversity": 0.5, "avg_sentence_length": 16.0, "sentence_length_variance": 0.0, "flesch_kincaid_grade": 0.0}

#: The wording of rendered results.
RENDERED = {
    "human": "**The text is** <span class='highlight-human'>**%.2f%%** likely <b>Human written</b>.</span>",
    "ai": "**The text is** <span class='highlight-ai'>**%.2f%%** likely <b>AI generated</b>.</span>",
    "unknown": "**Unknown** — text too short or invalid.",
    "forensic": "📋 Forensic verdict: **%s**",
    "risk": "%s Hallucination risk: **%s** (%s)",
    "risk_signs": {"LOW": "🟢", "MEDIUM": "🟡", "HIGH": "🔴"},
    "risk_sign": "⚪",
    "watermark": "🔏 Watermark signal detected — scheme: %s (%s confidence) *(EXPERIMENTAL)*",
    "reasoning": "🧠 Reasoning markers: AI score %.2f",
    "errors": "⚠️ Plugin warnings: %s",
    "line": "[%s] conf=%.1f%% model=%s forensic=%s hal=%s wm=%s errors=%d",
    "detector_model": "\n**Identified model:** `%s`",
    "detector_reasoning": "\n**Reasoning signal:** %.3f %s",
    "high_cot": "⚠ high CoT pattern",
    "low_cot": "✓ low CoT pattern",
    "detector_risk": "\n**Hallucination risk:** %s %s (%s)",
    "detector_risk_signs": {"LOW": "✅", "MEDIUM": "⚠️", "HIGH": "🚨"},
    "detector_watermark": "\n**⚠ Candidate watermark** detected (scheme: `%s`, confidence: %s) — EXPERIMENTAL",
    "detector_errors": "\n_Plugins with errors: %s_",
}

#: What a stored profile of an earlier version lacks.
PROFILE_DEFAULTS = {"schema_version": "1.0", "pos_bigrams_source": "none", "avg_dep_distance": 0.0, "max_dep_distance": 0.0, "avg_tree_depth": 0.0, "complex_sentence_ratio": 0.0, "burstiness_score": 0.0}

#: Indicator words and their strengths.
AI_WORDS = {
    "furthermore": 0.8, "moreover": 0.8, "additionally": 0.7, "consequently": 0.85, "therefore": 0.7, "thus": 0.7, "delve": 0.95, "utilize": 0.7, "leverage": 0.75, "robust": 0.7, "comprehensive": 0.7, "innovative": 0.65,
    "streamline": 0.75, "optimize": 0.7, "enhance": 0.65, "facilitate": 0.75, "implement": 0.65, "integrate": 0.65, "whilst": 0.8, "hence": 0.75, "thereby": 0.8, "aforementioned": 0.85, "pertaining": 0.8, "regarding": 0.6,
}
HUMAN_WORDS = {
    "kinda": 0.9, "gonna": 0.9, "wanna": 0.9, "like": 0.3, "basically": 0.4, "actually": 0.4, "honestly": 0.5, "literally": 0.5, "seriously": 0.5, "anyway": 0.6, "whatever": 0.7, "stuff": 0.6, "thing": 0.4, "things": 0.4,
    "guy": 0.6, "cool": 0.5, "awesome": 0.5, "crazy": 0.5,
}

#: What an item of evidence names where a sentence has no indicator; risk categories as they are shown; what people write.
NO_SIGNAL = "Elevated AI probability (score-based)"
CATEGORY_NAMES = {
    "lexical_risk": "Lexical Risk", "entity_anomaly": "Entity Anomaly", "entropy": "Entropy", "semantic_incoherence": "Semantic Incoherence", "vagueness": "Vagueness", "repetition": "Repetition",
    "structural_anomaly": "Structural Anomaly", "imprecision": "Imprecision",
}
STATISTICS_OF_PEOPLE = {"burstiness": (0.25, "burstiness"), "lexical_diversity": (0.70, "lexical diversity"), "avg_sentence_length": (16.0, "average sentence length")}

#: What a summary calls kinds of evidence.
EVIDENCE_NAMES = {
    "high_confidence_ai_sentence": "sentences of a machine", "human_writing_indicators": "sentences of a person", "uniform_high_ai_scores": "scores alike", "absent_human_markers": "no informal words", "low_perplexity": "low perplexity",
    "stylometric_anomaly": "unusual style", "high_hallucination_category": "risky categories", "statistical_deviation_from_baseline": "unusual statistics", "high_hallucination_risk": "risk of invented details",
    "elevated_hallucination_categories": "raised categories", "high_reasoning_model_signal": "marks of reasoning models", "moderate_reasoning_model_signal": "some marks of reasoning models", "candidate_watermark_signal": "a watermark",
    "high_perplexity_ai_signal": "a machine's perplexity", "perplexity_valley_detected": "valleys of perplexity", "fabricated_citations_detected": "references not found", "chimeric_citations_detected": "mixed references", "ornamental_references": "references not cited",
}
