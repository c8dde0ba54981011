"""Word lists, thresholds, presets and patterns that results depend on."""

from __future__ import annotations

# Sounds that are never words.
NONLEXICAL_FILLERS = (
    "um", "umm", "ummm", "uh", "uhh", "uhm", "erm", "er", "hmm", "hmmm",
    "mmm", "mm", "ahh", "uhhh", "eh",
    "उम", "उम्म", "हम्म", "हूँ", "अःः",
)

# Real words that are sometimes filler.
LEXICAL_FILLERS = (
    "matlab", "yaani", "yani", "toh", "na", "bas", "aisa", "waise",
    "arre", "achha", "acha", "haan", "samjhe", "yaar",
    "like", "actually", "basically", "literally", "obviously", "right",
    "so", "well", "okay", "ok",
    "मतलब", "यानी", "तो", "ना", "बस", "ऐसा", "वैसे", "अरे", "अच्छा", "हाँ", "हां",
)

# Words that are doubled on purpose.
REDUPLICATED = (
    "alag", "dheere", "baar", "jaldi", "thoda", "kabhi", "saath", "door",
    "paas", "kuch", "bahut", "acha", "achha", "chhota", "bada", "garam",
)

# Punctuation sets.
CLAUSE_PUNCTUATION = ".,!?;:।"
EDGE_PUNCTUATION = ".,!?;:\"'—–-"

# Detector thresholds, milliseconds and percent.
MIN_SILENCE_LEFT_MS = 50
REPEAT_MAX_GAP_MS = 350
REPEAT_CONFIDENCE = 80
FILLER_WINDOW_MS = 15_000
FILLER_WINDOW_COUNT = 4
DRAWN_OUT_TIMES_TEN = 16
PAUSE_BEFORE_POINTS, PAUSE_AFTER_POINTS, DRAWN_OUT_POINTS, CRUTCH_POINTS = 35, 35, 20, 15
SLIVER_MS = 10
MIN_WORD_MS = 80
PROTECTED_REASONS = ("retake",)

# Retake search.
MIN_PAUSE_MS = 450
PAUSE_SLACK_MS = 50
RETAKE_WINDOW_MS = 45_000
LOOKBACK = 8
MAX_GROUPS = 12
MIN_WORDS, MAX_WORDS = 6, 40
MIN_SIMILARITY = 0.35
MIN_SHARED_WORDS, MIN_SHARED_BIGRAMS = 3, 1
MIN_DURATION_RATIO = 0.4

# Caption presets as
# (name, font, size, highlight scale, upper case, words per line, text colour, highlight
#  colour, dim alpha, outline colour, shadow colour, outline width, shadow width, alignment,
#  bottom margin, animation type, scale start, scale end, duration ms).
STYLE_FIELDS = (
    "preset string, font string, font_size int, highlight_scale double, uppercase boolean, "
    "words_per_line int, text_color string, highlight_color string, dim_alpha int, "
    "outline_color string, shadow_color string, outline_width int, shadow_width int, "
    "alignment int, margin_v int, "
    "animation struct<type: string, scale_start: int, scale_end: int, duration_ms: int>"
)
STYLE_PRESETS = (
    ("default", "Arial Black", 72, 1.12, True, 3, "#FFFFFF", "#FFFF00", 170,
     "#000000", "#00000099", 4, 3, 2, 320, ("none", 50, 115, 150)),
    ("bold_impact", "Arial Black", 80, 1.12, True, 3, "#FFFFFF", "#FFFF00", 170,
     "#000000", "#00000099", 5, 3, 2, 320, ("pop", 50, 115, 150)),
    ("subtle", "Inter", 56, 1.12, False, 4, "#FFFFFF", "#88FF88", 170,
     "#000000", "#00000044", 2, 1, 2, 300, ("fade", 50, 115, 200)),
    ("karaoke", "Arial Black", 72, 1.12, True, 5, "#FFFFFF", "#FF5500", 170,
     "#000000", "#00000099", 4, 2, 2, 320, ("karaoke", 50, 115, 150)),
)
ANIMATION_DEFAULTS = ("none", 50, 115, 150)

# Ranges a style must keep, as (field, low, high).
STYLE_RANGES = (
    ("font_size", 24, 200), ("highlight_scale", 1.0, 1.5), ("words_per_line", 1, 8),
    ("dim_alpha", 0, 255), ("outline_width", 0, 10), ("shadow_width", 0, 10),
    ("alignment", 1, 9), ("margin_v", 0, 1920),
    ("animation.scale_start", 10, 100), ("animation.scale_end", 100, 200),
    ("animation.duration_ms", 50, 1000),
)
STYLE_COLORS = ("text_color", "highlight_color", "outline_color", "shadow_color")
ANIMATION_TYPES = ("none", "pop", "fade", "karaoke")
COLOR_PATTERN = "^#?([0-9a-fA-F]{6})([0-9a-fA-F]{2})?$"

# Clip caption presets as (name, font, size, text colour, highlight, outline,
# shadow, outline width, shadow width, words per line, bottom margin, animation, scale start,
# scale end, duration ms); colours are in subtitle order.
CLIP_PRESETS = (
    ("default", "Arial Black", 72, "&H00FFFFFF", "&H0000FFFF", "&H00000000", "&H66000000",
     4, 3, 3, 320, "none", 50, 115, 150),
    ("bold_impact", "Arial Black", 80, "&H00FFFFFF", "&H0000FFFF", "&H00000000", "&H66000000",
     5, 3, 3, 320, "pop", 50, 115, 150),
    ("subtle", "Inter", 56, "&H00FFFFFF", "&H0088FF88", "&H00000000", "&H44000000",
     2, 1, 4, 300, "fade", 50, 115, 200),
    ("karaoke", "Arial Black", 72, "&H00FFFFFF", "&H000055FF", "&H00000000", "&H66000000",
     4, 2, 5, 320, "karaoke", 50, 115, 150),
)

CLIP_ANIMATION = 11     # place of the animation in a clip preset

# Clip styles and what each asks for.
CLIP_STYLES = (
    ("auto", "Automatically detect the best clip style based on content"),
    ("funny", "Prioritize humor, punchlines, comedic timing, and laugh-out-loud moments"),
    ("educational", "Focus on insights, aha-moments, surprising facts, and clear explanations"),
    ("emotional",
     "Find emotionally powerful moments — vulnerability, triumph, heartbreak, inspiration"),
    ("controversial",
     "Surface bold opinions, hot takes, disagreements, and debate-worthy statements"),
    ("highlights", "Extract the most action-packed, visually striking, peak moments"),
)

# Content types in order of precedence, with the substrings that mark them.
CONTENT_TYPES = (
    ("podcast/interview", ("podcast", "interview", "episode", "guest", "host")),
    ("tutorial/educational", ("tutorial", "how to", "step by step", "learn", "guide", "course")),
    ("reaction", ("react", "reacts", "reaction", "watching")),
    ("vlog", ("vlog", "day in", "daily", "routine")),
    ("comedy", ("comedy", "funny", "prank", "roast", "sketch")),
    ("motivational/advice", ("motivation", "mindset", "success", "hustle", "advice")),
    ("news/commentary", ("news", "breaking", "report", "politics", "election")),
)
CONTENT_PREFIX_CHARS = 500

# What to look for per content type (our own wording, sent to the model as is).
CONTENT_CRITERIA = (
    ("podcast/interview", "Quotable or disputed answers, strong opinions, personal stories with a "
     "turn; skip greetings and sponsor reads."),
    ("tutorial/educational", "The step where the idea becomes clear, a common error put right, a "
     "visible before and after; skip setup and recap."),
    ("reaction", "The strongest response and the remark that explains it; skip silent viewing."),
    ("comedy", "A punchline with its setup, a callback that lands; skip slow builds."),
    ("motivational/advice", "One concrete piece of advice or a story with a lesson; skip general "
     "encouragement."),
    ("vlog", "Something unplanned, a genuine feeling, a striking place; skip travel and filler."),
    ("news/commentary", "The sharpest argument or the most surprising number; skip background."),
    ("general", "A moment that stands alone with an opening hook and an emotional peak; skip "
     "introductions and endings."),
)

# What rejected inputs are answered with.
BAD_TRANSCRIPT = "not a transcript: neither segments nor words"
BAD_TARGET = "target length must be a positive number of seconds"

# Audio rate names a timeline may declare.
AUDIO_RATES = (
    (32000, "32k"), (44100, "44.1k"), (48000, "48k"), (88200, "88.2k"),
    (96000, "96k"), (176400, "176.4k"), (192000, "192k"),
)

# Job table domains and ages in seconds.
JOB_KINDS = ("transcribe", "render")
JOB_STATUSES = ("queued", "transcribing", "romanizing", "rendering", "completed", "failed")
ACTIVE_STATUSES = ("queued", "transcribing", "romanizing", "rendering")
FINAL_STATUSES = ("completed", "failed")
STALE_SECONDS = 1800
STALE_MESSAGE = "Job interrupted (server restart) — please retry"
RETENTION_SECONDS = 48 * 3600
CLIP_TTL_SECONDS = 6 * 3600
JOB_TTL_SECONDS = 7200
WORK_TTL_SECONDS = 3 * 86400
DELETE_BATCH = 100

# Romanization of Devanagari. A letter stands for the Latin one below it;
# aspirates get an h and the two diphthongs their second vowel on top.
ROMAN_CHUNK = 80
ROMAN_CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ"
ROMAN_CONSONANT_BASES = "kkggnccjjnttddnttddnppbbmyrlvssshl"
ROMAN_ASPIRATES = "खघछझठढथधफभ"
ROMAN_VOWELS = "अआइईउऊऋएऐओऔ\u090d\u0911\u090e\u0912"
ROMAN_VOWEL_BASES = "aaiiuureaoaeoeo"
ROMAN_SIGNS = "ािीुूृेैोौ\u0945\u0949\u0946\u094a"
ROMAN_SIGN_BASES = "aiiuureaoaeoeo"
# Letters with the dot in them, as plain letters in the same order.
ROMAN_DOTTED, ROMAN_PLAIN = "\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f", "कखगजडढफय"
ROMAN_AI, ROMAN_AU = "ऐै", "औौ"
ROMAN_OTHER = "ंँः।ऽ०१२३४५६७८९"
ROMAN_OTHER_BASES = "nnh.'0123456789"
ROMAN_KILLER, ROMAN_NUQTA = "्", "़"
ROMAN_EXCEPTIONS = (
    ("maim", "main"), ("mem", "mein"), ("aura", "aur"), ("hama", "hum"),
    ("hai", "hai"), ("haim", "hain"), ("nahim", "nahin"), ("kya", "kya"),
)
