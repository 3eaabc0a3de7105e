"""operators of the phishing analytics library."""
