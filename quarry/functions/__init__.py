"""Column functions: text, HTML, privacy, intents, URLs, dates and replies."""
