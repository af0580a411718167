"""Column functions: text, labels, URLs, dates, responses; and the two Arrow functions for what columns can't express."""
