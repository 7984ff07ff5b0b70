"""Word lists, patterns and constants that decide results. Nothing here is logic.

Patterns are in Java syntax and meant to be used with `(?iU)` (see `text.rx`).
"""

# --- titles and companies
MARKDOWN_ESCAPE = r"\\([\\`*_{}\[\]()#+\-.!|>~&])"
GENDER_SUFFIX = r"(\w)[*/:_·]-?in(?:nen)?\b"
TITLE_NOISE = (
    r"\(\s*[mwdfhx]\s*(?:/\s*[mwdfhx]\s*)+\)"
    r"|\b[mwdfhx](?:\s*/\s*[mwdfhx])+\b"
    r"|\d{1,3}\s*[–\-—]\s*\d{1,3}\s*%"
    r"|\b\d{1,3}\s*%"
    r"|\(\s*\)"
)
TITLE_TAIL = (
    r"\s+(?:in|für|fuer|im\s+raum|region|raum)\s+[^,;–\-]{2,40}?\s+(?:gesucht|zu\s+besetzen)\s*$"
    r"|\s+(?:gesucht|zu\s+besetzen)\s*$"
    r"|\s+[–—]\s+[^–—]{5,90}$"
    r"|\s+-\s+[^-]{5,90}$"
)
TITLE_EDGE = " -–—,;"
TITLE_WORKLOAD = r"\b(\d{1,3})\s*(?:[–\-—]\s*(\d{1,3})\s*)?%"
LEGAL_FORM = r"\b(ag|sa|gmbh|sàrl|sarl|srl|llc|ltd|inc|co|kg|ohg|holding|group|gruppe|schweiz|switzerland|suisse)\b\.?"
TRUNCATED_BELOW = 350
AGENCY_HINTS = ["personal", "temporär", "temporar", "recruit", "staffing", "interim", "vermittlung", "stellenvermittlung", "job ag", "manpower", "adecco", "randstad", "universal-job"]

# --- publishers
PUBLIC_EMPLOYER = r"\b(kanton|stadt|gemeinde|bund|bundesamt|spital|klinik|universit|hochschule|schule|kindergarten|pflegezentrum|alterszentrum|museum|bibliothek|polizei|feuerwehr|post ch|sbb|swisscom|migros|coop)"
AGENCY_NAME = r"(personaldienstleist|personalberatung|personalvermittl|stellenvermittl|personal\b|recruit|staffing|temporär|temporar|interim|human capital|human resources|hr\s*services|manpower|adecco|randstad|hays|yellowshark|universal-job|job impuls|jobup|workmanagement|work selection|work4you|fachkraft\.ch|arbeitsvermittl)"
CLIENT_MENTION = (
    r"für\s+(?:unseren|einen)\s+(?:langjährigen\s+|renommierten\s+|geschätzten\s+)?(?:Kunden|Auftraggeber|Mandanten)\b"
    r"|im\s+Auftrag\s+(?:unseres|einer|eines)\b"
    r"|unser(?:e)?\s+Kund(?:e|in)\s+ist\s+(?:ein|eine)\b"
    r"|vermittelt\s+diese\s+Stelle"
    r"|für\s+(?:unsere|eine)\s+Kundin\b"
    r"|für\s+ein\s+(?:renommiertes\s+|erfolgreiches\s+)?Unternehmen\s+in\b"
)
AGENCY_REASONS = {"name": "Firmenname", "public": "öffentlicher Arbeitgeber", "declared": "Selbstdeklaration (surrogate)", "pattern": "Muster: %d Berufscodes bei %d Inseraten, %d Orte, Streuung %.0f km"}
PATTERN_MIN_ADS = 25
PATTERN_MIN_CODE_RATIO = 0.30
PATTERN_MIN_CITIES = 8
PATTERN_MIN_SPREAD_KM = 5.0
PATTERN_MIN_CLIENT_MENTIONS = 3

# --- contact data
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"
PHONE = r"(?:\+41|0041|\b0)\s?\(?\d{1,2}\)?[\s./-]?\d{3}[\s./-]?\d{2}[\s./-]?\d{2}\b"
EMAIL_PLACEHOLDER = "[E-Mail entfernt]"
PHONE_PLACEHOLDER = "[Telefon entfernt]"
CONTACT_KEYS = ["email", "emailAddress", "phone", "phoneNumber", "mainPhoneNumber", "telephone", "tel", "mobile", "mobilePhone", "fax", "faxNumber", "firstName", "lastName", "salutation", "rawPostAddress", "postAddress", "contact", "contactPerson"]
CONTACT_BLOCKS = ["publicContact", "owner", "jobCenterUserId", "applyChannel", "contact"]
NUMBER_KEY_HINTS = ["url", "link", "href", "website", "image", "logo", "src", "path", "id"]
CONTACT_KEY_SUFFIXES = ["phonenumber", "emailaddress", "faxnumber", "mobilenumber"]

# --- languages
STOP_WORDS = {
    "de": "und der die das den dem des mit für von bei sie wir uns eine einen einem ist sind wird werden dich dein deine ihre ihren nicht auch oder aber sowie durch über unter zwischen nach vor beim zum zur als wie sich haben hat",
    "fr": "et le la les des du une un pour vous nous dans est sont votre notre avec qui que sur par au aux ce cette leur plus sera être avoir vos nos chez ainsi dont afin lors",
    "it": "il lo la gli le dei delle del della per con una che nel nella sono anche come alla alle dal dalla suo sua loro più essere questo",
    "en": "the and for you our with are your this that will have from their about which they been would there these those into",
}
LANGUAGE_SAMPLE_CHARS = 1500
LANGUAGE_MIN_HITS = 5
LANGUAGE_MIN_RATIO = 1.5

# --- entity resolution
PORTAL_ORDER = ["job_room", "myjob", "ostjob", "zentraljob"]
TITLE_GATE = 0.88
CROSS_PORTAL = 0.87
NEAR_DUPLICATE = 0.85
SHINGLE_WORDS = 5
SIMILARITY_WEIGHTS = {"title": 0.45, "company": 0.35, "place": 0.20}

# --- scores
WORKLOAD_TOLERANCE = 30.0
RECENCY_HALF_LIFE_DAYS = 21.0
FLEXTIME = r"gleitzeit|gleitende\s+arbeitszeit|jahresarbeitszeit|flexible[nrs]?\s+arbeitszeit|zeitautonom|vertrauensarbeitszeit"
HOME_OFFICE = r"home\s?-?office|homeoffice|remote|telearbeit|mobiles?\s+arbeiten|hybrid"
SKILL_SHARE = 0.15
VOTE_NEIGHBOURS = 12
VOTE_SHARE = 0.4

# --- requirement levels
EDUCATION_RANK = {"keine": 0, "efz": 1, "fachausweis": 2, "hf": 3, "fh": 4, "uni": 5}
LEADERSHIP_TITLE = r"(leiter(?:in)?\b|leitung\b|leiten\w*|führung\w*|team\s?lead\w*|head\s+of|\bchef(?:in)?\b|geschäftsführ\w*)"
SENIOR_TITLE = r"(\bsenior\b|spezialist\w*|expert(?:e|in|en)?\b|manager(?:in)?\b|verantwortliche[rn]?\b|\bprincipal\b|\blead\b|koordinator\w*)"
JUNIOR_TITLE = r"\b(junior|einsteiger|trainee|nachwuchs|assistent)"
EDUCATION_PATTERNS = {
    "uni": r"\b(universit|master|uni/fh|bachelor|studium|hochschulabschluss)\b",
    "fh": r"\b(fachhochschul\w*|\bFH\b|\bBSc\b|\bBA\b)\b",
    "hf": r"\b(höhere\s+fachschule|\bHF\b|dipl\.?\s*techniker)\b",
    "fachausweis": r"\b(fachausweis|eidg\.?\s*dipl|\bBP\b|\bHFP\b)\b",
}
SOFT_MARKERS = ["von vorteil", "idealerweise", "im idealfall", "und/oder", "wenn möglich", "bevorzugt", "wünschenswert", "erwünscht", "ein plus", "nice to have", "vorteilhaft", "oder vergleichbar", "oder gleichwertig", "äquivalent"]
HARD_MARKERS = ["zwingend", "vorausgesetzt", "setzen wir voraus", "voraussetzung", "unabdingbar", "zwingende bedingung", "muss", "erforderlich", "bedingung", "verhandlungssicher", "stilsicher", "muttersprache"]
ENTRY_WELCOME = r"\b(berufseinsteig\w*|einsteiger\w*|lehrabgäng\w*|erste\s+berufserfahrung|auch\s+ohne\s+erfahrung|frisch\s+ab\s+lehre)"
NUMBER_WORDS = {"einem": 1, "einen": 1, "eine": 1, "ein": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10}
YEARS = r"\b(\d{1,2}|einem|einen|sechs|sieben|eine|zwei|drei|vier|fünf|acht|neun|zehn|ein)\b\s*(?:\+|\s*bis\s*\d+)?\s*Jahre?\s+(?:Berufs)?[Ee]rfahrung"
FURTHER_EDUCATION = r"weiterbildung\s+(?:als|zum|zur|im\s+bereich)\s+[\w/:.-]+"
EDUCATION_OFFER_MARKERS = ["bereitschaft", "bieten wir", "wir bieten", "perspektive", "unterstütz", "fördern", "ermöglichen", "bei interesse", "berufsbegleitend"]
REQUIRED_LANGUAGES = {"fr": r"franz[öo]sisch\w*|français|\bfranz\.\s*kenntnis", "it": r"italienisch\w*|italiano", "en": r"englisch\w*|english"}
CLAUSE_END = r"[\n;,]|(?<=[a-zäöüß])\.\s|\s[-*•]\s"
BLOCK_TAG = r"</?(?:br|li|p|div|tr|ul|ol|h[1-6])\b[^>]*>"

# --- sections
SECTION_START = r"^\s*[*#_\\\s]*(?:(?:ihre|deine|dein|ihr|unsere|die)?\s*(?:aufgaben|aufgabenbereich|tätigkeit\w*|hauptaufgaben|profil|anforderung\w*|qualifikation\w*|kompetenzen|voraussetzung\w*)|das\s+bringst?\s+du\s+mit|das\s+bringen\s+sie\s+mit|was\s+(?:du|sie)\s+mitbring\w*|damit\s+überzeug\w*|(?:dein|ihr)\s+tätigkeitsgebiet|wen\s+wir\s+suchen|wir\s+suchen)\b[^.!?]{0,70}$"
SECTION_END = r"^\s*[*#_\\\s]*(?:wir\s+bieten|unser\s+angebot|deine\s+vorteile|ihre\s+vorteile|was\s+wir\s+(?:dir|ihnen|bieten)|darauf\s+kannst\s+du\s+zählen|worauf\s+du\s+zählen\s+kannst|benefits|interessiert|neugierig|haben\s+wir\s+dein\s+interesse|kontakt\w*|ihr\s+ansprechpartner|bewerbung\w*|weitere\s+bewerbungsmöglichkeiten|spontanbewerbung|offene\s+stellen|über\s+uns|wir\s+über\s+uns|das\s+unternehmen|arbeitsort|anstellungsart|einsatzbeginn|pensum)\b.*$"

# --- words that say nothing about a group of advertisements
TERM_STOP_WORDS = [
    "und", "oder", "aber", "der", "die", "das", "dem", "den", "des", "ein", "eine", "einer", "eines", "einem", "einen", "ist", "sind", "war", "waren",
    "sein", "haben", "hat", "hatte", "wird", "werden", "wurde", "für", "von", "mit", "bei", "aus", "auf", "zu", "zum", "zur", "im", "in", "am", "an",
    "als", "auch", "nach", "über", "unter", "vor", "durch", "sowie", "sich", "ihre", "ihr", "unser", "unsere", "du", "dich", "dir", "sie", "wir",
    "uns", "ihnen", "man", "wenn", "dass", "damit", "sowohl", "als", "auch", "nicht", "kein", "keine", "mehr", "sehr", "gut", "gute", "guten", "neue",
    "neuen", "erste", "ersten", "wir", "bieten", "suchen", "bringst", "dein", "deine", "stelle", "stellen", "job", "jobs", "arbeit", "arbeiten",
    "mitarbeiter", "mitarbeiterin", "aufgaben", "profil", "anforderungen", "angebot", "bewerbung", "team", "unternehmen", "firma", "prozent",
    "pensum", "region", "schweiz", "ch", "ag", "gmbh", "sa",
]
