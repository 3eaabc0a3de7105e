"""streaming of the phishing analytics library."""
