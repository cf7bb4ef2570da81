"""Training-data operators: decontamination, licences, secrets, language, dedup, mixing, chat, pages, quality."""
