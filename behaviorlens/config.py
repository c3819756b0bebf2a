"""Fixed values and default parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass

#: The daily features in their canonical order.
FEATURES = (
    "logon_count", "logoff_count", "after_hours_logons", "weekend_logons", "unique_pcs_used",
    "usb_connect_count", "usb_disconnect_count", "after_hours_usb",
    "file_count", "file_to_removable_count", "unique_filenames",
    "email_sent_count", "email_to_external_count", "large_attachment_count", "total_email_size",
    "http_request_count", "job_search_visits", "cloud_upload_visits",
)

#: Business hours, sizes, key words and domains.
OPENS, CLOSES = 7, 19
LARGE_ATTACHMENT = 1_048_576
JOB_WORDS = ("job", "career", "linkedin", "indeed")
CLOUD_WORDS = ("dropbox", "wikileaks", "pastebin")
CONTENT_WORDS = (*JOB_WORDS, *CLOUD_WORDS, "resume", "salary", "offer", "confidential")
INTERNAL_DOMAIN = "dtaa.com"
JOB_DOMAINS = ("monster.com", "careerbuilder.com", "craigslist.org", "jobhuntersbible.com", "aol.com/jobs", "job", "career", "linkedin", "indeed")
CLOUD_DOMAINS = ("wikileaks.org", "dropbox")
KEYLOGGER_DOMAINS = ("refog.com", "softactivity.com", "keylogger")
#: File extensions by type code; others are 0.
FILE_TYPES = {
    1: (".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".csv"),
    2: (".pdf",),
    3: (".exe", ".dll", ".bat", ".cmd", ".sh"),
    4: (".zip", ".tar", ".gz", ".rar", ".7z", ".bz2"),
}


@dataclass(frozen=True)
class BaselineConfig:
    alpha: float = 0.05
    min_history: int = 14
    floor_ratio: float = 0.1
    epsilon: float = 1e-6
    min_cohort: int = 5


@dataclass(frozen=True)
class WindowConfig:
    size: int = 28
    stride: int = 7
    positive: float = 0.5
