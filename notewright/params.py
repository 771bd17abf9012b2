"""Job parameters, one frozen object per concern."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.rules import DEVICE_RULES, DeviceRule

# The defaults a run has when nothing is set.
POST_BASE_URL = "https://alert-api.com"
POST_ENDPOINT = "/device-orders"
POST_TIMEOUT_S = 30
POST_RETRIES = 3
NOTE_EXTENSIONS = (".txt", ".json")
ENVELOPE_KEYS = ("note", "physician_note", "text", "content")
MODEL_NAME = "gpt-4o"
MODEL_MAX_TOKENS = 1000
MODEL_TEMPERATURE = 0.1
STAGE_TEMPERATURE_CAP = 0.3
DOCUMENT_TYPE = "physician_note"
SCORE_THRESHOLD = 0.7
MAX_CORRECTIONS = 2
MODES = ("Fast", "Standard", "Thorough")


@dataclass(frozen=True)
class FileParams:
    extensions: tuple[str, ...] = NOTE_EXTENSIONS
    envelope_keys: tuple[str, ...] = ENVELOPE_KEYS
    envelope_extension: str = ".json"
    batch_mode: bool = True


@dataclass(frozen=True)
class RuleParams:
    """``word_boundary`` stops ``tens`` matching inside ``hypertension``; ``same_line``
    stops an empty label from taking its value from the next line. Both are off by
    default because the plain substring reading is the one existing results rest on."""

    word_boundary: bool = False
    same_line: bool = False


@dataclass(frozen=True)
class ModelParams:
    """``available`` says whether a completion source (live or replayed) exists at all. A single
    pass whose answer can't be read is left to the rules: over the note (``on_bad_response``
    ``note``), or over the answer's own text (``response``)."""

    available: bool = False
    on_bad_response: str = "note"
    model: str = MODEL_NAME
    max_tokens: int = MODEL_MAX_TOKENS
    temperature: float = MODEL_TEMPERATURE

    def __post_init__(self):
        if self.on_bad_response not in ("note", "response"):
            raise ValueError(f"{self.on_bad_response!r} is not 'note' or 'response'")


@dataclass(frozen=True)
class StagedParams:
    """``mode``: ``Fast`` asks the extractor stage alone, ``Standard`` all four, with one verdict and one
    correction; ``Thorough`` checks a corrected order again, until it is good enough or
    ``max_corrections`` are used up. ``on_model_failure``: ``rules`` uses the rule order at confidence 0.5 where the
    extractor stage gave nothing usable; ``unknown`` keeps the empty order at the default
    confidence. ``on_bad_validation``: ``basic`` checks the order itself, ``accept`` takes
    an unreadable verdict as valid. ``on_bad_correction``: ``keep`` or ``blank``."""

    enabled: bool = False
    mode: str = "Standard"
    document_type: str = DOCUMENT_TYPE
    require_validation: bool = True
    score_threshold: float = SCORE_THRESHOLD
    min_confidence: float = SCORE_THRESHOLD
    self_correction: bool = True
    max_corrections: int = MAX_CORRECTIONS
    on_model_failure: str = "rules"
    on_bad_validation: str = "basic"
    on_bad_correction: str = "keep"

    def __post_init__(self):
        for value, allowed in (
            (self.mode, MODES),
            (self.on_model_failure, ("rules", "unknown")),
            (self.on_bad_validation, ("basic", "accept")),
            (self.on_bad_correction, ("keep", "blank")),
        ):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")


@dataclass(frozen=True)
class PostParams:
    enabled: bool = True
    base_url: str = POST_BASE_URL
    endpoint: str = POST_ENDPOINT
    timeout_s: int = POST_TIMEOUT_S
    retries: int = POST_RETRIES


@dataclass(frozen=True)
class JobParams:
    """``run_id`` names the run in its results; a new one is made where it is empty."""

    run_id: str = ""
    files: FileParams = field(default_factory=FileParams)
    rules: RuleParams = field(default_factory=RuleParams)
    device_rules: tuple[DeviceRule, ...] = DEVICE_RULES
    model: ModelParams = field(default_factory=ModelParams)
    staged: StagedParams = field(default_factory=StagedParams)
    post: PostParams = field(default_factory=PostParams)
