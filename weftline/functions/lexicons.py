"""Word lists, markers, palettes and limits that results depend on."""

HEADING_MARK, CAPTION_MARK, BULLET_MARK = "## ", "! ", "• "

#: Words that open a heading.
STRONG_HEADINGS = (
    "intro introduction background overview summary conclusion conclusions objectives objective agenda outline section chapter part module topic review key materials methods methodology "
    "results finding findings discussion discussions recommendation recommendations appendix reference references motivation problem aim aims goals definition definitions abstract "
    "acknowledgements practical practices practice activity activities statement significance limitations hypothesis premise index contents mitigation adaptation interventions causes effects "
    "benefits strategies approaches risks management"
).split()

#: Words and phrases that make a section practical.
PRACTICAL_SECTION = (
    "practice|practices|exercise|exercises|activity|activities|implement|implementation|applied|application|applications|apply|how to|tutorial|guide|hands-on|workflow|procedure|procedures|"
    "step-by-step|steps|demonstration|demonstrate|tool|tools|experiment|lab|assignment|interactive|case study|checklist"
)
#: The narrower pattern that makes one point practical.
PRACTICAL_POINT = (
    "practice|practices|exercise|exercises|activity|activities|implement(?:ing|ation)?|hands-on|workflow|procedure|procedures|step-by-step|step by step|demonstrat\\w*|experiment|lab|"
    "assignment|interactive|case study|checklist|worksheet|tutorial|how to|configure|configuring|setup|set up|install|installation|build(?:ing)? the|enforce"
)
#: Headings that say nothing.
GENERIC_HEADINGS = [
    "overview", "introduction", "key concepts", "key concepts & overview", "summary", "conclusion", "conclusions", "objectives", "agenda", "topic", "topics", "details", "content",
    "presentation", "notes", "background", "main points", "general",
]
#: Table columns whose label is dropped, and those whose cells explain a row.
GENERIC_COLUMNS = ["", "-", "notes", "note", "detail", "details", "description", "comment", "comments", "example", "examples", "value", "content", "text", "meaning"]
RATIONALE_COLUMNS = [
    "why", "why it matters", "why it's important", "why it is important", "reason", "rationale", "purpose", "benefit", "impact", "effect", "consequence", "note", "notes", "comment",
    "comments", "remark",
]
#: Phrases of preliminary pages.
FRONT_MATTER = [
    "table of contents", "contents", "index", "índice", "sommaire", "inhaltsverzeichnis", "indice", "indice general", "sumário", "sumario", "inhoud", "содержание", "目次",
    "list of figures", "list of tables", "list of illustrations", "figure list", "abstract", "summary", "resumo", "resumé", "resume", "zusammenfassung", "riassunto", "foreword", "preface",
    "preliminary", "introduction to", "acknowledgement", "acknowledgment", "acknowledgements", "acknowledgments", "agradecimientos", "dedication", "about the author", "about the authors",
    "contributors", "revision history", "document history", "version history", "change log", "changelog", "glossary of terms", "copyright", "disclaimer", "legal notice", "imprint",
    "colophon", "how to use this document", "reading guide", "note to the reader", "executive summary", "course outline", "seminar outline",
]
#: Patterns of dates, authors, captions and numbered headings.
MONTHS = "(?:jan\\w*|feb\\w*|mar\\w*|apr\\w*|may|jun\\w*|jul\\w*|aug\\w*|sep\\w*|oct\\w*|nov\\w*|dec\\w*)"
DATE = (
    f"(?i)\\b{MONTHS}[.,]?\\s+\\d{{1,2}}(?:st|nd|rd|th)?(?:[,.]?\\s*\\d{{2,4}})?\\b|\\b\\d{{1,2}}(?:st|nd|rd|th)?\\s+{MONTHS}[.,]?\\s*(?:\\d{{2,4}})?\\b"
    "|\\b\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}\\b|\\b\\d{4}\\b"
)
AUTHOR = "(?i)^\\s*(?:by|presented\\s+by|written\\s+by|prepared\\s+by|reported\\s+by|author[s]?:?)\\s*:?\\s+(.+)$"
NOTHING_SAID = "Summary of the source content."
CAPTION = "(?i)^\\s*(figure|fig\\.?|abbildung|tabelle|table|chart|diagram|exhibit|graph|scheme|plate|image|listing|schaubild|diagrama|figura)\\s*[\\d]+(?:[.\\-][\\d]+)*\\s*[.:)\\-–—]?\\s+"
VARIANT_LABEL = (
    "(?i)^(?:model|option|variant|alternative|approach|method|phase|step|stage|type|version|tier|level|scenario|case|column|row|item|point|part)\\s*(?:[0-9]+|[IVXLC]+|[a-z]|[0-9]+\\.[0-9]+)$"
)
GENERIC_TAKEAWAY = (
    "(?i)\\b(this section|use the steps|follow a clear|best practices here|check the outcomes|integrate this approach|evaluate the impact|refine the process|the concept is analysed|"
    "the framework is compared|mastering these ideas|repeat the steps|a worked example|important definitions|everyday examples|key takeaway|summary point|action item|recap)\\b"
)
#: Words that are no subject when slides and figures are matched.
MATCH_STOPWORDS = (
    "the and of for with from that this introduction conclusion overview objectives section chapter fundamentals key concepts understanding practical activities seminar details content part "
    "using used based various different several important information example examples topic topics"
).split()
HEADING_NOISE = ["the", "and", "of", "for", "with", "from", "part", "a", "an", "to"]
CAPTION_LABELS = ["figure", "fig", "table", "chart", "diagram", "image", "exhibit", "no", "n"]

#: Lines that fill a slide of which nothing is left, by type and audience.
FILLERS = {
    ("practical", "Beginner"): [
        "Use the steps below to apply this approach in a simple, guided scenario.", "A worked example shows exactly how the steps fit together.", "Repeat the steps a few times to build confidence and accuracy.",
    ],
    ("practical", "Intermediate"): [
        "Follow a clear, repeatable process to put this approach into practice.", "Best practices here produce consistent and measurable results.", "Check the outcomes at each step to avoid common mistakes.",
    ],
    ("practical", "Advanced"): [
        "Integrate this approach into existing systems and larger workflows.", "Evaluate the impact using performance metrics and measured outcomes.", "Refine the process based on the results and team feedback.",
    ],
    ("theory", "Beginner"): [
        "This section explains the key ideas and why they matter, using simple language.", "Important definitions are introduced before the concept is taken further.", "Everyday examples make the main points easy to remember.",
    ],
    ("theory", "Intermediate"): [
        "This section builds a structured understanding of the concept and its context.", "The key principles are linked to professional decision-making in practice.", "Evidence and examples clarify when this concept applies.",
    ],
    ("theory", "Advanced"): [
        "The concept is analysed at a strategic level, including its trade-offs.", "The framework is compared with alternative models used in the field.", "Mastering these ideas supports leadership and innovation.",
    ],
}
COVER_LINES = {
    "Beginner": ["Clear explanations of foundational concepts and ideas.", "Practical examples you can understand and remember.", "Step-by-step guidance for learning and improvement."],
    "Advanced": ["Strategic insights and innovation opportunities.", "Advanced frameworks for complex problem-solving.", "Leadership and competitive advantage strategies."],
    "Intermediate": ["Comprehensive analysis of key concepts and principles.", "Practical recommendations for effective implementation.", "Professional framework for decision-making."],
}
SUBTITLES = {
    ("theory", "Beginner"): "Understanding the Fundamentals", ("theory", "Intermediate"): "Key Theoretical Concepts", ("theory", "Advanced"): "Advanced Theoretical Framework",
    ("practical", "Beginner"): "Practical Application Guide", ("practical", "Intermediate"): "Practical Implementation", ("practical", "Advanced"): "Advanced Implementation Strategies",
}

#: Limits of the planner and the deck.
STRUCTURAL_SLIDES, WORDS_PER_SLIDE = 4, 18
MAX_BULLETS, MIN_BULLETS, MAX_SLOTS, MAX_WORDS, TITLE_WORDS, MIN_CLAUSE = 5, 2, 4, 30, 9, 5
OUTLINE_ROWS, RECAP_LINES, RECAP_CHARS = 10, 6, 78
