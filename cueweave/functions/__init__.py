"""Native Column expressions: text rules, scripts, time codes, pauses, subtitles."""
