"""Fixed values by which evidence files are told apart and their columns and messages read."""

from __future__ import annotations

# Column aliases by canonical field, in order: of bank and other tables, and of call records.
BANK_COLUMNS = {
    "amount": ("amount", "txn amount", "transaction amount", "value", "credit", "debit"),
    "transaction_reference": ("utr", "reference", "reference id", "reference_no", "transaction id", "txn id", "rrn"),
    "event_time": ("date", "timestamp", "txn date", "transaction date", "value date", "time"),
    "sender": ("sender", "from", "payer", "remitter", "debit account"),
    "receiver": ("receiver", "to", "beneficiary", "payee", "credit account"),
    "account_identifiers": ("account", "account no", "account number", "a/c", "ifsc", "upi", "upi id"),
    "narration": ("narration", "particulars", "description", "remarks", "purpose"),
}
CALL_COLUMNS = {
    "sender": ("a-party", "a party", "aparty", "caller", "calling number", "calling party", "from", "originating number", "msisdn_a", "a_number"),
    "receiver": ("b-party", "b party", "bparty", "callee", "called number", "called party", "to", "terminating number", "msisdn_b", "b_number"),
    "phone_numbers": ("number", "phone", "contact", "msisdn"),
    "event_time": ("date", "time", "timestamp", "call date", "start time", "call start"),
    "message_direction": ("direction", "call type", "call_type", "type"),
    "duration": ("duration", "call duration", "seconds", "duration_seconds"),
    "device_identifier": ("imei", "device", "device id", "imsi"),
    "cell_site": ("cell id", "cell_id", "cell", "tower", "tower id", "site id", "lac", "cgi"),
}
# Header names, trimmed and in lower case, that mark a table's type.
CDR_MARKERS = (
    "a-party", "a party", "b-party", "b party", "calling number", "called number",
    "originating number", "terminating number", "msisdn_a", "msisdn_b", "a_number", "b_number",
)
CALL_MARKERS = ("duration", "call_type", "call type", "caller", "callee", "number", "direction")
MONEY_MARKERS = ("amount", "credit", "debit", "balance")
BANK_MARKERS = ("amount", "credit", "debit", "balance", "utr", "reference", "transaction", "narration", "particulars")
# Chat exports: how a message opens, how a notice does, what stands for media.
STAMP = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4},?\s+\d{1,2}:\d{2}(?::\d{2})?\s?(?:[AaPp]\.?[Mm]\.?)?"
CHAT_OPENS = rf"^\[?{STAMP}\]?\s*[-–]?\s*[^:]{{1,60}}:"
CHAT_MESSAGE = rf"^\[?({STAMP})\]?\s*[-–]?\s*([^:]{{1,60}}?):\s?(.*)$"
CHAT_NOTICE = rf"^\[?({STAMP})\]?\s*[-–]?\s*(.+)$"
MEDIA_OMITTED = r"(?i)<\s*(?:media|image|video|audio|sticker|document)\s+omitted\s*>"
MAIL_OPENS = ("from:", "to:", "subject:", "message-id:")
MAIL_HEADERS = ("From", "To", "Cc", "Bcc", "Date", "Subject", "Message-ID", "Reply-To")
# Source types that a declared category hints at, and those that are narrative reports.
CATEGORY_HINTS = {
    "whatsapp_screenshot": "screenshot", "screenshot": "screenshot", "chat_screenshot": "screenshot", "chat_export": "chat_export",
    "whatsapp_export": "chat_export", "bank_statement": "bank_record", "bank_record": "bank_record", "call_log": "call_log",
    "phishing_email": "email", "email": "email", "complaint_fir": "fir", "fir": "fir", "police_report": "police_report",
    "surveillance": "surveillance", "surveillance_report": "surveillance", "cdr": "cdr",
}
REPORT_TYPES = ("fir", "police_report", "surveillance")
CALL_TYPES = ("call_log", "cdr")
TABLE_TYPES = ("csv", "bank_record", "call_log", "cdr", "spreadsheet")
PARSERS = {"txt": "text", "eml": "text", "csv": "csv", "xlsx": "spreadsheet", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image"}


def columns_of(source_type: str) -> dict[str, tuple[str, ...]]:
    """The alias table of a source type."""
    return CALL_COLUMNS if source_type in CALL_TYPES else BANK_COLUMNS


def fold_header(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def map_columns(header: list[str], source_type: str = "csv") -> dict[str, str]:
    """Canonical field -> header cell: the first alias that occurs, compared without case and punctuation; the first column
    of equal names. No partial matches."""
    folded: dict[str, str] = {}
    for cell in header:
        if fold_header(cell):
            folded.setdefault(fold_header(cell), cell)
    found = {}
    for field, names in columns_of(source_type).items():
        hit = next((n for n in names if fold_header(n) in folded), None)
        if hit:
            found[field] = folded[fold_header(hit)]
    return found
