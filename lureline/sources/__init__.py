"""sources of the phishing analytics library."""
