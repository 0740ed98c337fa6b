"""Word lists, patterns, labels and keywords that results depend on.

Everything here is data, stated as is. Nothing here may be "improved": a changed
spelling changes the label a document gets.
"""

# --- fixed values: English stop words, in their published order -----------------
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# --- fixed values: characters and token patterns --------------------------------
SEPARATORS = "/(){}[]|@,;"                      # each becomes a space
KEPT_SYMBOLS = "0-9a-z #+_"                     # everything else is deleted
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"             # words of two characters or more
TOKENIZER_FILTER = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# --- fixed values: accepted file suffixes (exact case) --------------------------
IMAGE_SUFFIXES = ["png", "jpeg", "jpg", "JPEG", "JPG", "PNG"]
PDF_SUFFIXES = ["pdf", "PDF"]

# --- fixed values: training tags and result texts -------------------------------
TAGS = ["bankStatement", "passport", "electricityBill", "phoneBill", "pan",
        "drivingLicense", "aadhar", "bankPassbook", "rentalAgreement"]
UNCLASSIFIED = "Cannot be Classified"
INVALID_DOCUMENT = "Invalid Document"
EXTRACTION_FAILED = "unable to extract data"

# --- fixed values: labels the identity flow does not hand out -------------------
IDENTITY_DENIED = ["bankStatement", "bankPassbook", "electricityBill", "phoneBill",
                   "rentalAgreement"]

# --- fixed values: display names ------------------------------------------------
GENERAL_DISPLAY = {"aadhar": "Aadhar Card", "drivingLicense": "Driving License",
                   "voterID": "Voter ID"}
IDENTITY_DISPLAY = {"aadhar": "aadhar card", "pan": "pan card"}

# --- fixed values: keywords, as written -----------------------------------------
GAS_WORDS = [" gas ", " oil ", " refill ", "gas", "oil", "refill"]
STATEMENT_WORDS = ["account statement", "statement account", "transaction",
                   "statement period"]
STATEMENT_WORDS_SHORT = ["account statement", "statement account", "transaction"]
PHONE_WORDS = ["Jio DIGITAL LIFE", "JioPostPaid Plus", "Jio Number",
               "Vodafone India Ltd Company", "NNECT BROADBAND ",
               "MAHANAGAR TELEPHONE NIGAM LIMITED", "TATA DOCOMO", "BHARAT SANCHAR",
               "net+ BROADBAND", "broadband", "telephone"]
PHONE_WORDS_SHORT = ["Jio DIGITAL LIFE", "JioPostPaid Plus", "Jio Number",
                     "Vodafone India Ltd Company", "NNECT BROADBAND ",
                     "MAHANAGAR TELEPHONE NIGAM LIMITED", "TATA DOCOMO",
                     "BHARAT SANCHAR", "net+ BROADBAND", "broadband"]
ELECTRICITY_WORDS = ["kw", "kwh", "kvah", "tangedco"]
AADHAR_PHRASE = "unique identification authority india"
AADHAR_WORD = "uidai"
PAN_PHRASE = "permanent account number"

# --- fixed values: confidence thresholds ----------------------------------------
GENERAL_THRESHOLD = 0.7
UTILITY_THRESHOLD = 0.45
