"""Word lists the text operators depend on.

Fixed values: these lists must equal the ones the matched behaviour uses, so they
are stated plainly, in their natural order.  Order matters where noted (skill
output order, title tie order).
"""

# Skill dictionary, technical then soft skills, in output order.
# Entries are regular-expression sources (``c\+\+``; the dot in ``node.js`` is a wildcard).
TECHNICAL_SKILLS = [
    "python", "java", "javascript", r"c\+\+", "c#", "ruby", "go", "r", "php", "swift",
    "typescript", "kotlin", "rust", "scala", "perl", "sql", "bash", "powershell", "matlab",
    "html", "css", "react", "angular", "vue", "node.js", "django", "flask", "spring",
    "asp.net", "express", "jquery", "bootstrap", "laravel", "rails",
    "tensorflow", "pytorch", "keras", "scikit-learn", "pandas", "numpy", "matplotlib",
    "scipy", "machine learning", "deep learning", "nlp", "computer vision", "ai",
    "artificial intelligence", "data mining", "big data", "data visualization",
    "aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "ci/cd", "terraform",
    "ansible", "puppet", "chef", "devops", "sre", "cloud",
    "mysql", "postgresql", "mongodb", "oracle", "sql server", "sqlite", "redis",
    "cassandra", "elasticsearch", "dynamodb", "nosql", "rdbms",
    "r2r", "apc", "advanced process control", "virtual metrology", "neural networks",
    "semiconductor", "manufacturing", "statistical process control", "spc", "mes",
    "fault detection", "fdc", "equipment integration", "metrology", "yield improvement",
    "image processing", "multivariate analysis", "smartfactory", "dispatching",
    "git", "svn", "jira", "confluence", "slack", "trello", "agile", "scrum",
    "kanban", "waterfall", "figma", "adobe", "photoshop", "illustrator",
]
SOFT_SKILLS = [
    "communication", "teamwork", "leadership", "problem solving", "critical thinking",
    "decision making", "time management", "adaptability", "flexibility", "creativity",
    "organization", "stress management", "conflict resolution", "emotional intelligence",
    "negotiation", "persuasion", "presentation", "public speaking", "writing",
    "collaboration", "interpersonal", "customer service", "project management",
    "mentoring", "coaching", "analytical", "attention to detail", "multitasking",
    "research", "planning", "strategic thinking", "innovation", "self-motivation",
    "work ethic", "professionalism", "confidentiality", "integrity", "ethics",
]
SKILL_PATTERNS = TECHNICAL_SKILLS + SOFT_SKILLS

# résumé section words (a line containing one is a section header).
RESUME_SECTIONS = [
    "education", "experience", "work experience",
    "skills", "technical skills", "projects", "certifications",
    "achievements", "publications", "languages",
]

# Education keywords (matched as substrings of a lower-cased sentence).
EDUCATION_KEYWORDS = [
    "bachelor", "master", "phd", "doctorate", "bs", "ms", "ba", "ma", "mba",
    "associate", "degree", "university", "college", "institute", "school",
    "gpa", "major", "minor", "concentration", "graduated", "program",
]

# Job-title vocabulary; list order is the tie order of equally long titles.
JOB_PREFIXES = ["senior", "lead", "principal", "staff", "chief", "head",
                "junior", "associate", "assistant", "director"]
JOB_DOMAINS = ["engineer", "developer", "architect", "analyst", "scientist",
               "manager", "administrator", "specialist", "consultant", "technician"]
JOB_SPECIALTIES = ["software", "hardware", "systems", "application", "data", "network",
                   "ai", "ml", "machine learning", "frontend", "backend", "full stack",
                   "devops", "qa", "test", "research", "security", "cloud", "database",
                   "web", "mobile", "ios", "android", "embedded", "process", "product",
                   "r2r", "apc", "algorithm", "metrology"]

# The standard English stop-word list (179 words) used for keywords
# and candidate phrases.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# résumé-specific stop words added to the English list.
RESUME_STOP_WORDS = [
    "location", "resume", "curriculum", "vitae", "cv", "name", "email", "phone", "address",
    "linkedin", "github", "website", "objective", "summary", "profile", "contact",
    "references", "available", "upon", "request", "page", "january", "february",
    "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
]

KEYWORD_STOP_WORDS = sorted(set(ENGLISH_STOP_WORDS) | set(RESUME_STOP_WORDS))

# Application statuses accepted by a status update.
APPLICATION_STATUSES = ["Applied", "Screening", "Interview", "Technical Test", "Offer", "Hired", "Rejected"]

# Prompt templates (job summary bullets, short summary, yes/no grading).
BULLET_PROMPT = """
        The content is: {job_description}
        Tell me what's your main task, what you can do and summarize in 6 bullet points around 200 words:

        """
SUMMARY_PROMPT = """Base on {job_description}, summarize in 80 words, including which field it is, what's the main task:

                """
GRADE_PROMPT = """
        As a headhunter, you should filter applications for company to interview candidates who matches this position most. The information for this position is {job_description}. Got a resume: {resume}.
        This resume matchs the position, 'Yes' or 'No' ?\x20
        """
