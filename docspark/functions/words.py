"""Word lists and fixed texts."""

# Words that carry no content.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but "
    "by can could did do does doing down during each few for from further had has have having he her here hers him his "
    "how i if in into is it its itself just me more most my no nor not of off on once only or other our out over own "
    "same she should so some such than that the their theirs them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your also may might must "
    "shall upon via per et al"
).split()
# Words about the question, not its topic.
META_WORDS = (
    "document documents doc paper article text pdf report according discussed discuss mentioned mention described "
    "describe describes say says said state states stated tell give name list explain major main key one many much use "
    "used using page pages section sections provided provide present within across following"
).split()
# Words that ask for a summary.
SUMMARY_WORDS = (
    "summaris summariz summary summar overview point gist brief tldr recap key main important major quick short "
    "highlight takeaway outline everything"
).split()
# Stems that count as summary words besides those of the words above.
SUMMARY_STEMS = ("summarise", "summarize", "summary")
# Words that are never keywords.
KEYWORD_STOP = (
    "retrieved original archived isbn doi issn edition press also new see ref external links reference references "
    "wikipedia wikimedia web org com pdf citation accessed journal university"
).split()
# Words of bibliography entries.
CITATION_MARKS = ("Retrieved", "Archived", "ISBN", "ISSN", "doi", "PMID", "S2CID", "Bibcode", "arXiv")

NOT_FOUND = "The document doesn't contain this information."
NO_SUMMARY = "No summary could be generated from this document's text."
