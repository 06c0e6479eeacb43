"""Every threshold and weight, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# They decide results and are stated as they must be.
PATTERNS = [
    # type, key ("{1}": group 1 goes into the key, the value is group 2), base confidence, lower-cased text?, pattern
    ("preference", "preference", 0.80, True, r"i (?:prefer|like|love|enjoy) (.+)"),
    ("preference", "favorite_{1}", 0.90, True, r"my favorite (.+) is (.+)"),
    ("preference", "habitual_behavior", 0.70, True, r"i (?:always|usually) (.+)"),
    ("preference", "negative_preference", 0.80, True, r"i (?:hate|dislike|avoid) (.+)"),
    ("constraint", "cannot", 0.90, True, r"i (?:can't|cannot|won't) (.+)"),
    ("constraint", "must", 0.90, True, r"i (?:must|have to|need to) (.+)"),
    ("constraint", "allergy", 1.00, True, r"i'm (?:allergic to|allergic) (.+)"),
    ("constraint", "restriction", 0.70, True, r"(?:don't|do not) (.+)"),
    ("entity", "my_{1}", 0.80, True, r"my (\w+) is (?:named |called )?(\w+)"),
    ("entity", "user_name", 0.95, True, r"my name is (\w+)"),
    ("entity", "employer", 0.80, True, r"i work (?:at|for) (.+?)(?:\.|$)"),
    ("entity", "location", 0.85, True, r"i live in (.+?)(?:\.|$)"),
    ("commitment", "deadline", 0.85, True, r"i(?:'ll| will) (.+?) by (.+?)(?:\.|$)"),
    ("commitment", "promise", 0.90, True, r"i promise (?:to )?(.+)"),
    ("commitment", "commitment", 0.90, True, r"i'm committed to (.+)"),
    ("instruction", "always", 0.80, True, r"(?:always|remember to) (.+)"),
    ("instruction", "never", 0.80, True, r"(?:never|don't ever) (.+)"),
    ("instruction", "make_sure", 0.75, True, r"make sure (?:to )?(.+)"),
    ("fact", "account_number", 0.95, False, r"account(?: number| ending in|:)? (\d+)"),
    ("fact", "payment_amount", 0.90, False, r"(?:payment|balance|amount|bill) (?:of )?\$(\d+(?:,\d+)?)"),
    ("fact", "amount_due", 0.90, False, r"\$(\d+(?:,\d+)?).*(?:due|owed|outstanding)"),
    ("fact", "due_date", 0.90, False, r"due (?:on |date )?([A-Z][a-z]+ \d+(?:st|nd|rd|th)?)"),
    ("fact", "deadline_date", 0.85, False, r"(?:by|before) ([A-Z][a-z]+ \d+(?:st|nd|rd|th)?)"),
    ("fact", "payment_made", 0.90, False, r"(?:already |just )?paid.*?(\d+) days? ago"),
    ("fact", "payment_status_received", 0.85, False, r"payment.*?(?:received|processed|submitted)"),
    ("fact", "status_outstanding", 0.80, False, r"outstanding balance"),
    ("fact", "payment_arrangement", 0.85, False, r"payment (?:plan|extension) (?:of )?(\d+) days?"),
    ("fact", "request_payment_plan", 0.80, False, r"(?:set up|setup) (?:a )?payment plan"),
    ("fact", "customer_name", 0.85, False, r"(?:calling|speaking with) ([A-Z][a-z]+)"),
    ("fact", "speaker_name", 0.90, False, r"(?:this is |my name is )([A-Z][a-z]+)"),
]
#: Kinds of pattern: without a group the value is "true"; of two groups in a commitment the first is the value.
NO_GROUP = "true"

KEYWORDS = {
    "preference": ["prefer", "like", "hate", "love", "favorite", "always", "never"],
    "constraint": ["must", "cannot", "don't", "won't", "shouldn't", "allergic", "avoid"],
    "entity": ["my", "named", "called", "manager", "friend", "colleague", "family"],
    "instruction": ["always", "whenever", "remember to", "make sure", "don't forget"],
    "commitment": ["will", "promise", "committed", "deadline", "by", "before"],
    "fact": ["live in", "work at", "am", "is", "from", "born", "studied"],
    "payment": ["payment", "account", "balance", "due", "amount", "bill", "paid", "extension", "plan", "outstanding", "received"],
}
GREETINGS = ["hi", "hello", "hey", "thanks", "ok", "okay", "cool", "nice"]
SPECIFIC = [r"\d+", r"[A-Z][a-z]+", r"\b(am|pm|AM|PM)\b", r"@"]
MODIFIERS = {
    "always": 0.1, "never": 0.1, "definitely": 0.1, "absolutely": 0.1, "must": 0.1,
    "maybe": -0.2, "perhaps": -0.2, "possibly": -0.2, "might": -0.2,
    "sometimes": -0.15, "occasionally": -0.15, "could": -0.15,
}
UPDATES = [
    r"actually[,\s]+(.+)", r"i changed my mind[,\s]+(.+)", r"not anymore[,\s]+(.+)", r"i used to .+ but now (.+)",
    r"correction[,:\s]+(.+)", r"i meant[,:\s]+(.+)", r"let me correct that[,:\s]+(.+)",
]
TYPE_PRIORITY = {"constraint": 1.0, "instruction": 0.95, "preference": 0.7, "entity": 0.6, "commitment": 0.8, "fact": 0.5, "event": 0.4}
PROMPT_ORDER = ["constraint", "instruction", "preference", "entity", "commitment", "fact", "event"]
PROMOTION_TARGET = {
    "entity": ("CORE.md", "Identity"), "preference": ("PREFERENCES.md", "General Preferences"),
    "constraint": ("CONSTRAINTS.md", "Hard Constraints"), "instruction": ("INSTRUCTIONS.md", "Communication Style"),
}
DOCUMENT_TITLES = {
    "CORE.md": "Core Identity", "PREFERENCES.md": "User Preferences", "CONSTRAINTS.md": "Constraints & Limitations", "INSTRUCTIONS.md": "Instructions & Guidelines",
}
CORE_HEAD, RETRIEVED_HEAD = "### CORE MEMORY (Always Active)", "### LONG-TERM MEMORY (Retrieved)"


@dataclass(frozen=True)
class Settings:
    """Defaults are the ones that results are compared with; ``scope`` is () for one global store."""

    scope: tuple[str, ...] = ("user_id",)
    sensory_threshold: float = 0.3
    escalation_score: float = 0.5
    escalation_confidence: float = 0.7
    min_confidence: float = 0.6
    boost: float = 0.1
    max_confidence: float = 0.95
    semantic: bool = True
    signals: int = 5
    semantic_dedup: bool = True
    #: Accesses that one turn counts for a memory it retrieves: with vectors retrieval and prompt count one each.
    turn_accesses: int = 2
    semantic_limit: int = 100
    min_semantic: float = 0.1
    recency_limit: int = 50
    recency_score: float = 0.15
    always_on: tuple[str, ...] = ("constraint", "instruction")
    always_on_limit: int = 20
    always_on_floor: float = 0.5
    priority_types: tuple[str, ...] = ()
    priority_limit: int = 10
    priority_score: float = 0.3
    top: int = 50
    token_budget: int = 3000
    tokens_per_memory: int = 50
    recency_rate: float = 0.001
    frequency_rate: float = 0.05
    frequency_max: int = 20
    frequency_recent: float = 0.6
    weights5: dict = field(default_factory=lambda: {"semantic": 0.30, "type": 0.40, "recency": 0.10, "frequency": 0.05, "confidence": 0.15})
    weights3: dict = field(default_factory=lambda: {"semantic": 0.5, "type": 0.25, "recency": 0.25})
    dedup_threshold: float = 0.92
    dedup_limit: int = 5
    merge_threshold: float = 0.85
    merge_length: int = 500
    merge_mode: str = "intended"
    merge_enabled: bool = True
    merge_rows: int = 1000
    merge_limit: int = 5
    promote_enabled: bool = True
    consolidation_enabled: bool = True
    consolidation_every: int = 50
    consolidation_least: int = 10
    decay_enabled: bool = False
    decay_age: int = 500
    decay_idle: int = 300
    decay_rate: float = 0.005
    decay_floor: float = 0.1
    decay_delete: float = 0.05
    promote_confidence: float = 0.90
    promote_mentions: int = 3
    promote_accesses: int = 5
    promote_age: int = 50


DEFAULT = Settings()
