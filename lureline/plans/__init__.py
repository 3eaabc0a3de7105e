"""plans of the phishing analytics library."""
