"""The patterns and word lists that decide what a line of a transcript is.

All stay within what Java's and RE2's regular expressions have in common, so that the same text serves Spark and the checks.
"""

# (pattern, group of the title or 0, group of the name)
SPEAKERS_COLON = (
    (r"HON\.\s+((?:SIR|PROFESSOR|DR\.|MR\.|MRS\.|MS\.)?\s*[A-Z][A-Z.\s'-]+(?:\s[A-Z][a-z]+)*):", 0, 1),
    (r"(MR|MRS|MS|DR)\.?\s+([A-Z]\.?\s*[A-Z][A-Z.\s'-]+):", 0, 2),
    (r"(MR|MRS|MS|DR)\s+SPEAKER:", 0, 1),
    (r"(CLERK(?:\s+ASSISTANT)?|SERGEANT-AT-ARMS|DEPUTY\s+SPEAKER):", 0, 1),
    (r"(?m)(?:^|\.\s+|\?\s+|!\s+)([A-Z][A-Z.\s'-]+(?:\s[A-Z][a-z]+)*):", 0, 1),
    (r"(HON\.|MR\.|MRS\.|MS\.|DR\.)?\s*([A-Z]\.\s+[A-Z][A-Z\s'-]+):", 1, 2),
)
SPEAKERS_DASH = (
    (r"HON\.\s+([A-Z][A-Z.\s'-]+(?:\s[A-Z][a-z]+)*)\.?-", 0, 1),
    (r"HON\.\s+((?:PRIME MINISTER|MINISTER|LEADER|ATTORNEY-GENERAL|SPEAKER|DEPUTY SPEAKER)[A-Z\s'-]*)\.?-", 0, 1),
    (r"(MR\.?|MRS\.?|MS\.?|MADAM)\s+SPEAKER\.?-", 0, 1),
    (r"^\s*([A-Z][A-Z.\s'-]+(?:\s[A-Z][a-z]+)*)\.?-", 0, 1),
    (r"HON\.\s+([A-Z][A-Z.\s'-]+(?:\s[A-Z][a-z]+)*):", 0, 1),
)
SPEAKERS_TITLED = (
    (r"(?i)HON\.\s+((?:PROFESSOR|DR\.|MR\.|MRS\.|MS\.)?\s*[A-Z][A-Z.\s'-]+(?:\s[A-Z][a-z]+)*):", 0, 1),
    (r"(?i)(MR|MRS|MS|DR)\s+SPEAKER:", 0, 1),
    (r"(?i)(MR|MRS|MS|DR)\.?\s+([A-Z]\.?\s*[A-Z][A-Z.\s'-]+):", 1, 2),
    (r"(?i)(DEPUTY SPEAKER):", 0, 1),
    (r"(?i)(SECRETARY-GENERAL):", 0, 1),
)
SPEAKER_PARAGRAPH = r"^((?:Hon\.?|Professor|Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Madam)\s+[A-Z][A-Za-z'.\-]+\s*[\-–—])"

SPEAKER_LINE = r"(?i)^(?:HON\.|MR\.|MADAM|DR\.|MRS\.|MS\.)\s+[A-Z]"
SPEAKER_LINE_STRONG = r"(?i)^(?:HON\.\s+[A-Z][A-Z\s.'-]+(?:\s*\([^)]+\))?[:\-.]|(?:MR\.|MADAM|DR\.|MRS\.|MS\.)\s+[A-Z][A-Z\s.'-]+[:\-.]|HON\.\s+(?:SPEAKER|DEPUTY\s+SPEAKER|ACTING\s+SPEAKER|ATTORNEY-GENERAL|PRIME\s+MINISTER)[:\-.]|HON\.\s+(?:ASSISTANT\s+MINISTER|MINISTER|LEADER\s+OF)[^:]+[:\-.])"
SPEAKER_LINE_SHORT = r"^(?:HON\.\s+.*[.-]\s*|(?:MR|MRS|MS|MADAM)\.?\s+SPEAKER[.-]\s*|[A-Z][A-Z\s.'-]+[.-]\s*)$"
SHORT_LINE = 100
DIALOGUE = (
    r"(?i)^(HON\.\s+[A-Z][A-Z\s.'-]+(?:\s*\([^)]+\))?)[\s:\-.]+(.*)$",
    r"(?i)^((?:MR\.|MADAM|DR\.|MRS\.|MS\.)\s+[A-Z][A-Z\s.'-]+)[\s:\-.]+(.*)$",
    r"(?i)^(HON\.\s+[A-Z\s.'-]+)[\s:\-.]+(.*)$",
)
PROCEDURAL = r"(?i)^(?:Question put\.?|Motion agreed to\.?|Motion (?:carried|passed|lost)\.?|Vote recorded\.?|House adjourned\.?|The (?:House|Parliament) (?:met|resumed).*|\(.*\)|Amendment.*|Division.*)$"
HEADING = r"(?i)^(?:[A-Z][A-Z\s]+|ORAL QUESTIONS?|WRITTEN QUESTIONS?|MINISTERIAL STATEMENTS?|BILLS?|MOTIONS?|MINUTES?|MESSAGES?|PAPERS?|PRESENTATION OF.*|DEBATE ON.*|RESUMPTION OF DEBATE.*|Question No\.\s*\d+.*|\(Question No\.\s*\d+/\d+\))$"
HEADING_LENGTH = 50
HEADING_WORDS = "PRESENT|MINUTES|QUESTIONS|ORAL QUESTIONS|WRITTEN QUESTIONS|MINISTERIAL STATEMENT|ADJOURNMENT|SUSPENSION OF STANDING ORDERS|PRESENTATION OF PAPERS|COMMUNICATIONS FROM THE SPEAKER|BILLS|MOTIONS|PETITIONS"
HEADING_WORDS_LENGTH = 100
PAGE_MARKER = r"(?i)^(?:Page \d+|\d+|\d+\s+Questions|Questions\s+\d+|\d+th\s+\w+\.,\s+\d{4})$"
QUESTION_SECTION = r"(?i)Question\s+No\.\s*\d+|Oral\s+Questions?|Written\s+Questions?|QUESTIONS\s+AND\s+ANSWERS"
ORAL_SECTION = r"(?i)ORAL\s+QUESTIONS?|Question\s+Time"
WRITTEN_SECTION = r"(?i)WRITTEN\s+QUESTIONS?"
QUESTION_START = r"(?i)Question\s+No\.\s*\d+"
QUESTION_SPEAKER = r"^(?:MR|MRS|MS|HON|DR)\.?\s+[A-Z].*?:"
ASKING = r"(?i)\bquestion\b|\basking\b|\bask\b"
QUESTION_ITEM = r"^\((\d+)\)\s*(.+)"
QUESTION_REFERENCE = r"\(Q/No\.\s*(\d+/\d+)\)"
ABBREVIATION = r"\b(?:Mr|Mrs|Ms|Dr|Hon|Sr|Jr|vs|etc|i\.e|e\.g)\.$"
ADDRESS = r"(?i)Mr\.\s*Speaker|Honourable Members?|Sir|Madam"

FILE_DATES = ((r"DAY-\d+-\w+-(\d+)-(\w+)-(\d+)", 2000), (r"\w+-(\d+)-(\w+)-(\d{4})", 0))
TEXT_DATE_LONG = r"[A-Z]\w*day,?\s+(\d{1,2})(?:st|nd|rd|th)?\s+([A-Z][a-z]+),?\s+(\d{4})"
TEXT_DATE = r"([A-Z][a-z]+)\s+(\d{1,2}),?\s+(\d{4})"
PARLIAMENT = r"(?i)(\d+)(?:st|nd|rd|th)\s+Parliament"
SESSION = r"(?i)(\d+)(?:st|nd|rd|th)\s+Session"
MEETING = r"(?i)(\w+)\s+Meeting"

FORMATTED = ("speech-block", "speaker-name", "speech-content", "procedural", "line-height: 1.8", "max-width: 900px")
LINK_NAME = r"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)-\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
LINK_TEXT = r"(?i)Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LINK_SKIPPED = ("handbook", "strategic-plan", "policy", "travel", "mps-travel")
LINK_DATE = r"(?i)(Mon|Tue|Wed|Thu|Fri|Sat|Sun)-(\d{1,2})-(.*?)-(\d{4})"
SKIPPED_PATHS = r"contents\.html|env/|__pycache__"
CENTRED = "text-align: center"
TITLED_PERSON = r"^(?:Hon\.?|Professor|Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Madam)\s+[A-Z]"
